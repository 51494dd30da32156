"""Texts to sections: headings, labels, blocks.

Lines stay in the array of their row; blocks are slices of it. Null texts give no section; a text without a heading gives
one block, labelled ``unknown`` or by the shape of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.functions.text import word_count
from corpuswright.lexicon import COMBINED_RULES, CONFLICT_PHRASES, CONTRIBUTION_PHRASES, FUNDING_PHRASES, HEADING_RULES, REFERENCE_HEADINGS, REFERENCE_MARKS, RESEARCH_PROSE, THANKS_PHRASES
from corpuswright.operators.lookup import first_rule
from corpuswright.operators.rules import literal


def section_label(heading: Column, rules=HEADING_RULES, combined=COMBINED_RULES) -> Column:
    """Label of a heading: combined headings first, then the first rule that occurs; else null."""
    return F.coalesce(first_rule(heading, combined, 1), first_rule(heading, rules, 1))


def second_label(heading: Column, combined=COMBINED_RULES) -> Column:
    return first_rule(heading, combined, 2)


def is_heading(line: Column, rules=HEADING_RULES) -> Column:
    """A short line that starts with a capital (behind an optional number), ends with no full stop
    or comma, has at most 12 words and a letter run, and carries a known label."""
    t = F.trim(line)
    shape = (F.length(t) < 100) & ~t.rlike("[.,]$") & t.rlike(r"^(?:[0-9]+[.0-9]* +)?[A-Z]") & t.rlike("[a-zA-Z]{3,}")
    # the rules are only read for lines of the right shape
    return F.when(shape & (F.size(F.split(t, " +")) <= 12), section_label(t, rules).isNotNull()).otherwise(False)


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, heading, lines, body): what stands before the first heading (block 0) and under each.

    Headings are found in the row's own array of lines and the blocks are its slices: linear in the lines, no row
    leaves its task. ``lines`` counts the heading too. Texts without a key or text give none; an empty block 0 neither.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, F.split(text, "\n").alias("_l"))
    rows = rows.withColumn("_h", F.filter(F.sequence(F.lit(1), F.size("_l")), lambda i: is_heading(F.element_at("_l", i))))
    start = lambda k: F.when(k == 0, 0).otherwise(F.get("_h", k - 1))
    end = lambda k: F.when(k == F.size("_h"), F.size("_l") + 1).otherwise(F.get("_h", k))
    cut = F.transform(
        F.sequence(F.lit(0), F.size("_h")),
        lambda k: F.struct(k.alias("block"), F.when(k > 0, F.trim(F.element_at("_l", start(k)))).alias("heading"), (end(k) - F.greatest(start(k), F.lit(1))).alias("lines"), F.array_join(F.slice("_l", start(k) + 1, end(k) - start(k) - 1), "\n").alias("body")),
    )
    return rows.select(key, F.inline(cut)).where("lines > 0")


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block, half, heading, label, body, words): non-empty blocks in order, with their section.

    A block without a known heading, and the only block of a text, is classified by the shape of its lines. A combined
    heading over a body of more than 100 characters is split at the first paragraph break from 100 characters before its
    middle, at the middle if there is none within 200 behind it; not where its second section has appeared before.
    """
    rows = blocks(docs, key, text).withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", "")).where("body <> ''")
    # a text's blocks are bounded by the text
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "heading", "body"))).alias("b"))
    # one known heading at least in front of text, else the whole is one unlabelled block
    rows = rows.withColumn("b", F.when(F.size("b") > 1, F.transform("b", lambda x: _labelled(x["block"], x["heading"], x["body"]))).otherwise(F.transform("b", lambda x: _labelled(x["block"], F.lit(None).cast("string"), x["body"], x["heading"]))))
    rows = rows.select(key, F.posexplode("b").alias("_i", "x"), F.col("b").alias("_b")).select(key, "x.*", F.exists(F.slice("_b", F.lit(1), F.col("_i")), lambda y: (y["label"] == F.col("x.second")) | (y["second"] == F.col("x.second"))).alias("_known"))
    middle = F.expr("cast(floor(length(body) / 2) as int)")
    brk = F.expr("locate('\\n\\n', body, greatest(1, cast(floor(length(body) / 2) as int) - 99))")
    m = F.when((brk == 0) | (brk - 1 > middle + 200), middle).otherwise(brk - 1)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    split = F.col("second").isNotNull() & (F.length("body") > 100) & ~F.coalesce("_known", F.lit(False))
    halves = F.when(
        split, F.array(F.struct(F.col("label").alias("label"), strip(F.expr("substring(body, 1, m)")).alias("body")), F.struct(F.col("second").alias("label"), strip(F.expr("substring(body, m + 1)")).alias("body")))
    ).otherwise(F.array(F.struct(F.col("label").alias("label"), F.col("body").alias("body"))))
    out = rows.withColumn("m", m).select(key, "block", "heading", F.posexplode(halves).alias("half", "h"))
    return out.select(key, "block", "half", "heading", F.col("h.label").alias("label"), F.col("h.body").alias("body")).withColumn("words", word_count(F.col("body"))).where("body <> ''")


def _labelled(block: Column, heading: Column, body: Column, shown: Column | None = None) -> Column:
    label = F.coalesce(section_label(heading), reclassified(body, heading))
    return F.struct(block.alias("block"), (heading if shown is None else shown).alias("heading"), body.alias("body"), label.alias("label"), second_label(heading).alias("second"))


def merged_sections(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, label, body, words): blocks of one label joined in order by a blank line."""
    order = F.array_sort(F.collect_list(F.struct("block", "half", "body")))
    body = F.array_join(F.transform(order, lambda p: p["body"]), "\n\n")
    return parts.groupBy(key, "label").agg(F.min("block").alias("first_block"), body.alias("body"), F.sum("words").alias("words"))


def with_abstract(merged: DataFrame, abstracts: DataFrame, key: str = "doc_id", abstract: str = "abstract") -> DataFrame:
    """``merged`` and, for texts in which none was found, the abstract from the metadata as a last section."""
    have = merged.where("label = 'abstract'").select(key)
    extra = abstracts.where(F.trim(F.coalesce(abstract, F.lit(""))) != "").join(have, key, "left_anti")
    last = extra.select(key, F.lit("abstract").alias("label"), F.lit(2**31 - 1).alias("first_block"), F.col(abstract).alias("body"), word_count(F.col(abstract)).cast("long").alias("words"))
    return merged.select(key, "label", "first_block", "body", "words").unionByName(last)


def reclassified(text: Column, heading: Column) -> Column:
    """Class of an unlabelled block by the shape of its lines; ``unknown`` stays research."""
    part = lambda c, parts: c.rlike("|".join(literal(p) for p in parts))
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(lines)
    cited = F.size(F.filter(lines, lambda x: x.rlike(r"^\[[0-9]+\]|^[0-9]+\.\s+[A-Z]") | part(F.lower(x), REFERENCE_MARKS)))
    low = F.lower(F.coalesce(text, F.lit("")))
    prose = part(low, RESEARCH_PROSE)
    return (
        F.when(F.trim(low) == "", "unknown")
        .when(part(F.lower(F.coalesce(heading, F.lit(""))), REFERENCE_HEADINGS), "references")
        .when((cited >= F.greatest(F.lit(4), F.floor(n * F.lit(0.6)))) & ~prose, "references")
        .when(part(low, FUNDING_PHRASES) & (n <= 8) & ~prose, "funding")
        .when(part(low, CONFLICT_PHRASES) & (n <= 6), "conflict_of_interest")
        .when(part(low, CONTRIBUTION_PHRASES) & (n <= 8), "author_contributions")
        .when(part(low, THANKS_PHRASES) & (n <= 8) & ~prose, "acknowledgments")
        .otherwise("unknown")
    )
