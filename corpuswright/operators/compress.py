"""Extractive compression to a token budget, verbatim and with provenance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.functions.text import ratio4, token_estimate, word_count, word_set
from corpuswright.lexicon import MAX_SENTENCES, MIN_SENTENCES, NON_RESEARCH, OTHER_MIN, SECTION_ORDER
from corpuswright.operators.ranking import top_n
from corpuswright.operators.scores import technical_score
from corpuswright.operators.skew import skew_join


def minimum_of(section: Column) -> Column:
    out = None
    for name, n in MIN_SENTENCES.items():
        out = F.when(section == name, n) if out is None else out.when(section == name, n)
    return out.otherwise(OTHER_MIN)


def section_rank(section: Column) -> Column:
    """Reading order of a section; unknown labels come last."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SECTION_ORDER]), section), F.lit(0)) + F.when(section.isin(*SECTION_ORDER), 0).otherwise(len(SECTION_ORDER) + 1)


def provenance_id(paper: Column, section: Column, index: Column) -> Column:
    """paper - first four letters of the section in capitals - index of two digits or more."""
    return F.concat_ws("-", paper, F.upper(F.substring(F.rpad(F.regexp_replace(section, "[^A-Za-z]", ""), 4, "x"), 1, 4)), F.lpad(index.cast("string"), F.greatest(F.lit(2), F.length(index.cast("string"))), F.lit("0")))


def minimum_cover(sentences: DataFrame, paper: str, section: str, score: str, order: list[str]) -> DataFrame:
    """The best sentences of each section up to its minimum, whatever the budget."""
    best = top_n(sentences, [paper, section], [F.desc(score), *order], max(MIN_SENTENCES.values()))
    return best.where(F.col("rank") <= minimum_of(F.col(section)))


def budgeted(sentences: DataFrame, paper: str = "paper_id", section: str = "section", text: str = "text", score: str = "composite", seq: str = "row_id", floor: float = 0.65, goal: float = 0.70, ceiling: float = 0.75, most: dict[str, int] = MAX_SENTENCES, threshold: float = 0.7, rank: str | None = None) -> DataFrame:
    """(paper, seq, reason, tokens) of each sentence kept.

    First the minimum cover of each section, then the rest by descending score with these tests in
    order: stop when the goal is met; skip a section that holds its maximum (``most``, the cover counts;
    a label it does not list has that of unknown); past the floor skip a near copy of a kept
    sentence of the section; past the floor skip what would cross the ceiling; else keep. A skipped
    sentence is never seen again. Budgets are shares of the paper's own token sum, rounded half to even.

    ``reason``: min_coverage, or for what fills the budget textrank+technical, textrank, technical or
    budget_fill, by a graph rank (column ``rank``; none without it) above 0 and a technical score from 0.25 on.

    The scan is a stream over rows sorted by (paper, turn): a paper's sentences are never gathered, the
    state is what has been kept. Rows without paper or text are left out; ties go to the smaller ``seq``.
    """
    base = sentences.where(F.col(paper).isNotNull() & F.col(text).isNotNull() & ~F.col(section).isin(*NON_RESEARCH)).withColumn("tokens", token_estimate(F.col(text)))
    total = base.groupBy(paper).agg(F.sum("tokens").alias("total"), F.count("*").alias("weight"))
    cover = minimum_cover(base, paper, section, score, [seq]).select(seq, F.lit(1).alias("covered"))
    rows = skew_join(base, total, [paper], "weight").join(cover, seq, "left")
    ranked = F.coalesce(F.col(rank), F.lit(0.0)) > 0 if rank else F.lit(False)
    technical = technical_score(F.col(text)) >= 0.25
    merit = F.when(ranked & technical, "textrank+technical").when(ranked, "textrank").when(technical, "technical").otherwise("budget_fill")
    rows = rows.withColumn("reason", F.when(F.col("covered") == 1, "min_coverage").otherwise(merit))
    turn = F.struct(F.coalesce(1 - F.col("covered"), F.lit(1)).alias("late"), (-F.col(score)).alias("score"), F.col(seq).alias("seq"))
    rows = rows.select(F.col(paper).alias("paper"), F.col(section).alias("section"), "tokens", "total", "reason", turn.alias("turn"), word_set(F.col(text)).alias("words"))
    rows = rows.repartition("paper").sortWithinPartitions("paper", "turn")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, kept, full, done = None, 0, {}, {}, False
        for b in batches:
            out = []
            for paper_, section_, w, total_, reason, turn_, words in zip(b["paper"], b["section"], b["tokens"], b["total"], b["reason"], b["turn"], b["words"]):
                if paper_ != now:
                    now, used, kept, full, done = paper_, 0, {}, {}, False
                    low, want, high = (round(x * total_) for x in (floor, goal, ceiling))
                if turn_["late"]:
                    if done or (used >= want and used >= low):
                        done = True
                        continue
                    if full.get(section_, 0) >= most.get(section_, most["unknown"]):
                        continue
                    mine = set(words)
                    if used + w >= low and any(len(mine & k) >= threshold * len(mine | k) for k in kept.get(section_, ()) if mine and k):
                        continue
                    if used + w > high and used >= low:
                        continue
                else:
                    mine = set(words)
                used += w
                full[section_] = full.get(section_, 0) + 1
                kept.setdefault(section_, []).append(mine)
                out.append((paper_, turn_["seq"], reason, w))
            yield pd.DataFrame(out, columns=["paper", "seq", "reason", "tokens"])

    return rows.mapInPandas(scan, "paper string, seq long, reason string, tokens int")


def compression_metrics(kept: DataFrame, every: DataFrame, paper: str, section: str, text: str) -> DataFrame:
    """Ratios and coverages of each paper: kept sentences against all, research sections against all."""
    research = ~F.col(section).isin(*NON_RESEARCH)
    a = every.where(f"{paper} is not null").groupBy(paper).agg(
        F.sum(token_estimate(F.col(text))).alias("tokens"), F.sum(word_count(F.col(text))).alias("words"), F.countDistinct(section).alias("sections"), F.countDistinct(F.when(research, F.col(section))).alias("research"))
    b = kept.where(f"{paper} is not null").groupBy(paper).agg(
        F.sum(token_estimate(F.col(text))).alias("kept_tokens"), F.count("*").alias("kept"), F.countDistinct(section).alias("covered"), F.countDistinct(F.when(research, F.col(section))).alias("research_covered"),
        F.sum(F.coalesce(F.col("source_verified").cast("int"), F.lit(0))).alias("verified"))
    j = a.join(b, paper, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    kept_ratio = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), ratio4(zero("kept_tokens") / F.col("tokens")))).otherwise(F.lit(0.0))
    share = lambda x, y: F.when(F.col(y) > 0, ratio4(zero(x) / F.col(y))).otherwise(F.lit(0.0))
    return j.select(
        paper, "tokens", "words", zero("kept_tokens").alias("kept_tokens"), zero("kept").alias("kept_sentences"), kept_ratio.alias("retained_ratio"), ratio4(F.lit(1.0) - kept_ratio).alias("reduction_ratio"),
        share("covered", "sections").alias("section_coverage"), share("research_covered", "research").alias("research_coverage"),
        F.when(zero("kept") > 0, ratio4(zero("verified") / zero("kept"))).otherwise(F.lit(1.0)).alias("faithfulness"),
    )


def with_flags(metrics: DataFrame, coverage: DataFrame, paper: str, floor: float = 0.65, least_tokens: int = 500) -> DataFrame:
    """``metrics`` with ``status`` (not_evaluated where only the abstract was there, by ``coverage``: paper, coverage_type) and
    ``shortfall``: tokens missing to the floor of texts of more than ``least_tokens``."""
    j = metrics.join(coverage, paper, "left")
    want = F.bround(F.lit(floor) * F.col("tokens"))
    short = F.when((F.col("tokens") > least_tokens) & (F.col("kept_tokens") < want), (want - F.col("kept_tokens")).cast("long")).otherwise(F.lit(0).cast("long"))
    return j.withColumn("status", F.when(F.col("coverage_type") == "abstract_only", "not_evaluated").otherwise("evaluated")).withColumn("shortfall", short)


def fact_sheet_header(papers: DataFrame, paper: str) -> DataFrame:
    """(paper, header): title, up to five authors and the year, as the head of a fact sheet; missing parts are left out."""
    from corpuswright.operators.report import people

    line = F.concat_ws("\n", F.nullif(F.col("title"), F.lit("")), F.nullif(people(F.col("authors")), F.lit("")), F.col("year").cast("string"))
    return papers.select(paper, line.alias("header"))


def fact_sheet_text(sentences: DataFrame, paper: str, section: str, index: str, text: str, seq: str) -> DataFrame:
    """(paper, sheet): headings in reading order, their sentences in text order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(seq).alias("s"), F.col(text).alias("t"))))
    body = F.array_join(F.transform(ordered, lambda x: x["t"]), "\n")
    parts = sentences.where(f"{paper} is not null and {text} is not null and {section} is not null").groupBy(paper, section).agg(body.alias("body"))
    block = F.concat(F.lit("## "), F.col(section), F.lit("\n"), F.col("body"))
    whole = F.array_sort(F.collect_list(F.struct(section_rank(F.col(section)).alias("r"), F.col(section).alias("n"), block.alias("b"))))
    return parts.groupBy(paper).agg(F.array_join(F.transform(whole, lambda x: x["b"]), "\n\n").alias("sheet"))
