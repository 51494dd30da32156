"""Usability, validity, coverage and verbatim tests on texts. Rules apply top to bottom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.functions.text import squeeze, token_estimate, word_count
from corpuswright.lexicon import DISCOURSE, ERROR_PHRASES, LANDING_PHRASES, NO_ABSTRACT, NON_RESEARCH, WRAPPER_WORDS
from corpuswright.operators.lookup import hits


def usable(text: Column, least_words: int = 300, errors=ERROR_PHRASES, landing=LANDING_PHRASES) -> Column:
    """Whether a text is more than an error, paywall or landing page; false for null and blank."""
    words = word_count(text)
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 3000))
    return (
        F.when(words < least_words, False)
        .when(hits(head, list(errors)) > 0, False)
        .when((hits(head, list(landing)) >= 2) & (words < 500), False)
        .otherwise(True)
    )


def has_abstract(text: Column, least_words: int = 5, missing=NO_ABSTRACT) -> Column:
    """Whether an abstract is real: no stand-in and long enough; false for null."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return ~low.startswith("[") & ~F.rtrim(low, F.lit(".")).isin(*[m.rstrip(".") for m in missing]) & (word_count(text) >= least_words)


def coverage(full_text: Column, abstract: Column, full_words: int = 600, least_words: int = 300) -> Column:
    words = word_count(full_text)
    return (
        F.when(usable(full_text, least_words) & (words >= full_words), "full_paper")
        .when(usable(full_text, least_words), "partial_paper")
        .when(has_abstract(abstract), "abstract_only")
        .otherwise("unavailable")
    )


def best_text(candidates: list[tuple[str, Column]], least_words: int = 300) -> tuple[Column, Column]:
    """(text, name) of the first candidate that is usable: the waterfall over sources."""
    texts = F.coalesce(*[F.when(usable(c, least_words), c) for _, c in candidates])
    names = F.coalesce(*[F.when(usable(c, least_words), F.lit(n)) for n, c in candidates])
    return texts, names


def verdicts(docs: DataFrame, parts: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """(key, verdict): structural validity of each text from its sections; ordered rules."""
    p = parts.withColumn("tokens", token_estimate(F.col("body")))
    research = ~F.col("label").isin(*NON_RESEARCH, "abstract")
    roll = p.groupBy(key).agg(
        F.count_if(research).alias("research"), F.count_if(research & (F.col("label") != "unknown")).alias("known"), F.count_if(F.col("label") == "abstract").alias("abstracts"),
        F.sum(F.when(research, F.col("tokens")).otherwise(0)).alias("research_tokens"),
    )
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    split = F.filter(F.split(F.regexp_replace(low, r"\s+", " "), " "), lambda w: w != "")
    wrapper = F.size(F.filter(split, lambda w: F.regexp_replace(w, r"^[.,;:\"'()\[\]]+|[.,;:\"'()\[\]]+$", "").isin(*WRAPPER_WORDS)))
    ends = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[a-zA-Z0-9][.!?](?:\s|$)"), F.lit(0)))
    d = docs.select(key, F.col(text).alias("_t"), word_count(F.col(text)).alias("_w"), token_estimate(F.col(text)).alias("_n"), wrapper.alias("_wrap"), ends.alias("_ends"), hits(F.col(text), list(DISCOURSE)).alias("_talk"))
    d = d.join(roll, key, "left")
    verdict = (
        F.when(F.col("_t").isNull() | (F.trim("_t") == ""), "reject: empty")
        .when(F.coalesce("research", F.lit(0)) == 0, "reject: no research section")
        .when(F.col("_w") < least_words, "reject: below minimum")
        .when((F.col("_wrap") > 0.4 * F.col("_w")) & (F.col("_w") > 500), "reject: publisher wrapper")
        .when((F.col("abstracts") > 0) & (F.col("known") == 0) & (F.col("research_tokens") < 1000), "reject: abstract and unlabelled text only")
        .when((F.col("known") == 0) & (F.col("abstracts") == 0) & ((F.col("_ends") < 3) | (F.col("_talk") < 2)), "reject: no discourse")
        .when((F.col("_n") > 3000) & (F.col("research_tokens") < 400), "reject: wrapper")
        .otherwise("accept")
    )
    return d.select(key, verdict.alias("verdict"))


def coverage_of_parts(parts: DataFrame, key: str, text: str, full_words: int = 600, least_words: int = 300) -> DataFrame:
    """(key, words, usable, full): coverage of texts that lie in parts, from counts of the parts alone.

    Error and landing phrases are looked for at the start of each part; nothing is put together.
    """
    head = F.lower(F.substring(F.coalesce(F.col(text), F.lit("")), 1, 3000))
    p = parts.select(key, word_count(F.col(text)).alias("w"), (hits(head, list(ERROR_PHRASES)) > 0).alias("e"), hits(head, list(LANDING_PHRASES)).alias("l"))
    s = p.groupBy(key).agg(F.sum("w").alias("words"), F.max("e").alias("e"), F.max("l").alias("l"))
    ok = (F.col("words") >= least_words) & ~F.col("e") & ~((F.col("l") >= 2) & (F.col("words") < 500))
    return s.select(key, "words", ok.alias("usable"), (ok & (F.col("words") >= full_words)).alias("full"))


def eligible(access_status: Column, coverage_type: Column) -> Column:
    """Whether a paper's full text can serve as evidence: by its access status, by its coverage where that is null or empty."""
    by_cover = F.coalesce(coverage_type, F.lit("unavailable")).isin("full_paper", "partial_paper")
    return F.when(F.coalesce(access_status, F.lit("")) != "", access_status == "FULL_TEXT_AVAILABLE").otherwise(by_cover)


def verbatim(source: Column, sentence: Column) -> Column:
    """Whether the sentence occurs in the source, exactly or but for white space; false for null."""
    return F.coalesce(source.contains(sentence) | squeeze(source).contains(squeeze(sentence)), F.lit(False))


def domain_factor(text: Column, words: list[str], cut: float = 0.45) -> Column:
    """1, or ``cut`` for texts that use the vocabulary of another field."""
    return F.when(hits(text, words, "word") > 0, F.lit(cut)).otherwise(F.lit(1.0))
