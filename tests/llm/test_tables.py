"""Every query of the subpackage with odd tables: empty, nulls in every column, repeated rows, clashing extra columns."""

import pytest

pytest.importorskip("corpuswright.llm")

from pyspark.sql import functions as F

from corpuswright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("papers", "patents", "paper_sections", "extracted_sentences", "documents", "eval_items", "patent_sources", "given_name_forms", "token_windows")
CLASH = ("key", "n", "h", "ctx", "rank", "trust", "s", "b", "token", "host", "id", "size", "bucket", "node", "word", "shard", "len", "slice", "cap", "field", "value", "origin")


def copy(spark, tmp, change):
    for t in TABLES:
        change(spark.read.parquet(f"{SF}/{t}.parquet"), t).write.parquet(f"{tmp}/{t}.parquet")
    return str(tmp)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return copy(spark, tmp_path_factory.mktemp("empty"), lambda df, t: df.where("false"))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    def change(df, t):
        nulls = df.limit(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        key = df.columns[0]
        half = df.limit(3).select(key, *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name != key]).withColumn(key, F.col(key) + 10_000_000 if t not in ("patent_sources", "given_name_forms") else F.col(key))
        out = df.unionByName(df.limit(5)).unionByName(nulls).unionByName(half)
        return out.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])

    return copy(spark, tmp_path_factory.mktemp("odd"), change)


@pytest.mark.parametrize("name", QUERIES)
def test_empty(spark, empty, name):
    df = QUERIES[name](spark, empty)
    assert df.columns and df.count() == 0


@pytest.mark.parametrize("name", [q for q in QUERIES if q.endswith("_found") or q in ("p6_assignment", "p3_groups")])
def test_odd(spark, odd, name):
    """Rows of nulls and repeated rows change nothing but add their own items."""
    got = QUERIES[name](spark, odd)
    plain = QUERIES[name](spark, SF)
    a, b = {tuple(r) for r in got.collect()}, {tuple(r) for r in plain.collect()}
    if name == "p6_assignment":
        assert {r[2] for r in b} == {r[2] for r in a}
    else:
        assert a == b
