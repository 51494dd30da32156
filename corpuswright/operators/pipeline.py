"""Raw documents to their extractive digests, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswright.functions.text import clean_html, looks_like_html, mark_sentences, squeeze
from corpuswright.lexicon import NON_RESEARCH
from corpuswright.operators import compress, scores, sections
from corpuswright.session import materialise


def sentences_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, key, section, idx, text): sentences of the research sections of each document.

    Markup is cleaned first. ``row_id`` is a hash of the place, so it is stable across runs.
    """
    clean = docs.select(key, F.when(looks_like_html(F.col(text)), clean_html(F.col(text))).otherwise(F.col(text)).alias(text))
    parts = sections.sections(clean, key, text).where(~F.col("label").isin(*NON_RESEARCH))
    flat = parts.select(key, "block", "half", "label", F.posexplode(mark_sentences(F.col("body"))).alias("idx", "s"))
    flat = flat.select(key, F.col("label").alias("section"), "block", "half", "idx", squeeze(F.col("s")).alias("text")).where("text <> ''")
    return flat.select(F.xxhash64(key, "block", "half", "idx").alias("row_id"), key, "section", (F.col("block") * 100_000 + F.col("half") * 50_000 + F.col("idx")).alias("idx"), "text")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row_id, section, idx, text, reason, tokens): the sentences each document is reduced to.

    Sections, sentences, graph rank within a section, technical score, composite, budget. The sentence table is
    written once and every later stage works on it; ties are broken by place.
    """
    flat = materialise(sentences_of(docs, key, text), "sentences")
    rank = scores.graph_rank(flat, [key, "section"], "row_id", F.col("text"), ["idx"]).select("row_id", "score")
    scored = flat.join(rank, "row_id").withColumn("composite", F.round(scores.composite(F.col("score"), scores.technical_score(F.col("text")), F.col("section")), 9))
    kept = compress.budgeted(scored.withColumn("paper", F.col(key).cast("string")), paper="paper", rank="score")
    return flat.join(kept.select(F.col("seq").alias("row_id"), "reason", "tokens"), "row_id").select(key, "row_id", "section", "idx", "text", "reason", "tokens")
