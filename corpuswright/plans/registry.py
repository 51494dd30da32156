"""All queries of the core, with the SQL that a second engine runs against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuswright.plans import report_queries, score_queries, source_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(sorted({**text_queries.Q, **score_queries.Q, **report_queries.Q, **source_queries.Q}.items()))
ORACLES: dict[str, str] = {**text_queries.SQL, **score_queries.SQL, **report_queries.SQL, **source_queries.SQL}
flagship = score_queries.q00_flagship
