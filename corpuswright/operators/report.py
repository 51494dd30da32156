"""Report tables and sinks: counts, decks, grids and chart series as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswright.operators.ranking import top_n


def cut(text: Column, longest: int) -> Column:
    """Text of at most ``longest`` characters, three dots where something was left out; '' for null."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest - 3), F.lit("..."))).otherwise(t)


def people(names: Column, most: int = 5) -> Column:
    """Up to ``most`` names, 'et al.' behind them where there are more."""
    shown = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(shown, F.lit(" et al."))).otherwise(F.coalesce(shown, F.lit("")))


def cover_counts(**tables: DataFrame) -> DataFrame:
    """(part, n): rows of each part of a report, one row a part."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def deck(df: DataFrame, group: str, score: str, seq: str, n: int = 3) -> DataFrame:
    """The n best rows of each group, ties by ``seq``."""
    return top_n(df, [group], [F.desc_nulls_last(score), seq], n)


def grid(df: DataFrame, **widths: int) -> DataFrame:
    """The named columns cut to their widths."""
    return df.select(*[cut(F.col(c).cast("string"), w).alias(c) for c, w in widths.items()])


# What a detail says where a paper does not.
NOT_THERE = ("", "Not extracted")


def details(df: DataFrame, key: str, fields: dict[str, str], missing: str = "Not available in abstract.") -> DataFrame:
    """(key, place, label, content): one row for each labelled field of a row, in order; ``missing`` for what is not there."""
    rows = F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(label).alias("label"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("content")) for i, (c, label) in enumerate(fields.items())])
    flat = df.select(key, F.inline(rows))
    return flat.withColumn("content", F.when(F.col("content").isin(*NOT_THERE), missing).otherwise(F.col("content")))


def compression_table(metrics: DataFrame, key: str) -> DataFrame:
    """(key, tokens, kept_tokens, reduction, coverage, grade): rows of papers with tokens, percentages rounded half to even to one place."""
    reduction = F.bround(F.col("reduction_ratio") * 100.0, 1)
    rows = metrics.where("tokens > 0").select(key, "tokens", "kept_tokens", reduction.alias("reduction"), F.bround(F.col("section_coverage") * 100.0, 0).alias("coverage"))
    return rows.withColumn("grade", F.when(F.col("reduction") >= 60, "high").when(F.col("reduction") >= 30, "medium").otherwise("low"))


def series(df: DataFrame, label: str, value: Column, n: int, seq: str) -> DataFrame:
    """(place, label, value): the n largest values as whole numbers, for a chart."""
    rows = df.select(F.lit(0).alias("all"), cut(F.col(label), 30).alias("label"), F.floor(value).cast("int").alias("value"), F.col(seq).alias("seq"))
    return top_n(rows, ["all"], [F.desc_nulls_last("value"), "seq"], n, "place").select("place", "label", "value")


def nonzero_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value; values without rows do not appear."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def write_metrics(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A small table as one JSON-lines file; more than ``most`` rows raise an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: write the table as Parquet")
    df.coalesce(1).write.mode("overwrite").json(path)
