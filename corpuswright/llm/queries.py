"""Queries of the training-data operators: each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswright.llm import boilerplate, contamination, name_variants, near_duplicates, packing, sentences, shared_spans, survivors
from corpuswright.session import materialise, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.outside_lines(table(spark, sf_dir, "paper_sections").where("captured_from = 'web_page'"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(table(spark, sf_dir, "patents"), table(spark, sf_dir, "patent_sources"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, sf_dir, "papers"), n=3, threshold=0.5)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, sf_dir, "papers"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = table(spark, sf_dir, "paper_sections").where(F.col("captured_from").isin("xml", "pdf"))
    sections = sections.select(F.lit("paper_sections").alias("origin"), F.col("section_id").alias("row_id"), F.col("original_text").alias("text"))
    extracted = table(spark, sf_dir, "extracted_sentences").select(F.lit("extracted_sentences").alias("origin"), "row_id", "text")
    return sentences.sentences(sections.unionByName(extracted))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = name_variants.distinct_names(table(spark, sf_dir, "papers"), table(spark, sf_dir, "patents"))
    return name_variants.entities(names, table(spark, sf_dir, "given_name_forms"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.variant_pairs(materialise(p5_entities(spark, sf_dir), "named"))


def p6_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = materialise(packing.token_counts(table(spark, sf_dir, "documents")), "tokens")
    return packing.pack(counts, table(spark, sf_dir, "token_windows"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the windows of each capacity are."""
    size = F.sum(F.col("end_token") - F.col("start_token"))
    used = p6_assignment(spark, sf_dir).groupBy("window_id", "bin_id").agg(size.alias("tokens"))
    totals = used.groupBy("window_id").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"))
    caps = table(spark, sf_dir, "token_windows").select("window_id", "window_name", "capacity_tokens")
    share = F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))
    return totals.join(F.broadcast(caps), "window_id").select("window_id", "window_name", "bins", "tokens", share.alias("fill"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_groups, p4_found, p5_entities, p5_found, p6_assignment, p6_fill, p7_found, p8_found)}
ORACLES: dict[str, str] = {}
