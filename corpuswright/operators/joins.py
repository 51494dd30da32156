"""Joins with a stated order: last build row wins, by position, nearest vectors in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswright.operators.ranking import distributed_rank
from corpuswright.session import materialise


def last_wins(probe: DataFrame, build: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """``probe`` left outer joined with the build row of largest ``seq`` of its key, as build_<field>
    and build_seq. The build side is reduced to one row a key before it moves; Spark broadcasts it only if
    its measured size allows."""
    last = build.groupBy(key).agg(F.max(F.col(seq)).alias("build_seq"), *[F.max_by(f, F.col(seq)).alias(f"build_{f}") for f in fields])
    return probe.join(last, key, "left")


def kept_of(probe: DataFrame, build: DataFrame, key: str, drop: str) -> DataFrame:
    """``probe`` without the rows whose build row says ``drop`` (boolean); rows without a build row stay."""
    return probe.join(build.where(F.col(drop)).select(key).distinct(), key, "left_anti")


def positional(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Row i of the left with row i of the right, null where the right is shorter. Both positions come from
    distributed ranks."""
    a = distributed_rank(left.withColumn("_all", F.lit(0)), ["_all"], [left_order], "position").drop("_all")
    b = distributed_rank(right.withColumn("_all", F.lit(0)), ["_all"], [right_order], "position").drop("_all")
    return a.join(b, "position", "left")


def nearest(vectors: DataFrame, key: str, vector: str, every: int, k: int, block: int = 2048) -> DataFrame:
    """(q, id, sim, rank): the k most similar rows of every ``every``-th key, by cosine, against all rows.

    The stated query set is cut into blocks; each block visits every partition of the table as one
    matrix product, partitions keep k candidates a query, and the final choice shuffles only those.
    Equal similarities go to the smaller key. Rows with null or zero vectors are no candidates.
    """
    queries = vectors.where((F.pmod(F.col(key), F.lit(every)) == 0) & F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    queries = materialise(queries, "queries")
    spark = vectors.sparkSession
    count = queries.count()
    blocks = max(1, -(-count // block))
    out = None
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).toPandas()
        if not len(part):
            continue
        ids = part["q"].to_numpy()
        m = np.array(part["v"].tolist(), dtype=np.float64)
        m = m / np.where((n := np.sqrt((m * m).sum(axis=1))) == 0, 1.0, n)[:, None]
        shared = spark.sparkContext.broadcast((ids, m))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            for b in batches:
                x = np.array(b["v"].tolist(), dtype=np.float64).reshape(len(b), -1)
                norm = np.sqrt((x * x).sum(axis=1))
                keys = b["id"].to_numpy()[norm > 0]
                x = x[norm > 0] / norm[norm > 0][:, None]
                s = np.round(m @ x.T, 6)
                rows = []
                for r in range(len(ids)):
                    order = np.lexsort((keys, -s[r]))
                    order = order[keys[order] != ids[r]][:k]
                    rows.append(pd.DataFrame({"q": ids[r], "id": keys[order], "sim": s[r][order]}))
                yield pd.concat(rows, ignore_index=True)

        found = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(scan, "q long, id long, sim double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "q long, id long, sim double, rank int")
    from corpuswright.operators.ranking import top_n

    return top_n(out, ["q"], [F.desc("sim"), "id"], k)
