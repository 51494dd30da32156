"""Where the full text of a paper may lie, and which of the texts found is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.operators.filters import best_text


def preprint_id(url: Column) -> Column:
    """Identifier in a preprint address (abs, pdf or html page), without version; '' if there is none."""
    return F.regexp_extract(url, r"(?i)/(?:abs|pdf|html)/([0-9]{4}\.[0-9]{4,5}|[a-z-]+/[0-9]{7})", 1)


def archive_id(url: Column) -> Column:
    """PMC identifier in an address, upper case; '' if there is none."""
    return F.upper(F.regexp_extract(url, r"(?i)(PMC[0-9]+)", 1))


def resolved(papers: DataFrame, resolver: DataFrame) -> DataFrame:
    """``papers`` with ``resolved_url`` of their doi from a resolver table (doi, url); case of a doi does not matter.

    The resolver is reduced to one row a doi first; rows without doi keep null.
    """
    table = resolver.where("doi is not null").groupBy(F.lower("doi").alias("_doi")).agg(F.min("url").alias("resolved_url"))
    return papers.withColumn("_doi", F.lower(F.nullif("doi", F.lit("")))).join(table, "_doi", "left").drop("_doi")


def waterfall(papers: DataFrame, key: str, texts: DataFrame, order: list[str], least_words: int = 300) -> DataFrame:
    """(key, text, found): the first usable text of each paper in the order of places.

    ``texts``: (key, place, text), one row a place at most counts (the longest). The places become columns by
    one aggregation, so the waterfall is an expression and later places cost nothing once one fits.
    """
    by_place = texts.where(F.col("place").isin(*order)).groupBy(key).agg(*[F.max_by(F.when(F.col("place") == p, F.col("text")), F.when(F.col("place") == p, F.length("text"))).alias(f"_{i}") for i, p in enumerate(order)])
    text, found = best_text([(p, F.col(f"_{i}")) for i, p in enumerate(order)], least_words)
    return papers.select(key).join(by_place, key, "left").select(key, text.alias("text"), found.alias("found"))
