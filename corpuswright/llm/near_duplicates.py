"""Near-duplicate records: ProbMinHash signatures, banding, exact verification.

Problem 3. Pairs of records whose sets of ``n``-word sequences reach a Jaccard similarity.

How it works
------------
1. Each record becomes its set of shingle hashes. Records with equal sets are one *class*: only
   its smallest record goes on, so copies never meet each other in a bucket.
2. A ProbMinHash signature: every shingle sends arrivals of a Poisson process whose rate is its
   weight; each arrival falls on one register, which keeps the earliest. A shingle stops as soon as
   its next arrival is later than the latest register. Two signatures agree in a register with the
   probability Jaccard similarity of the weighted sets, which for equal weights is the plain one.
3. ``bands`` of ``width`` registers give bucket keys. They are shuffled once, sorted by bucket, and read as a
   stream: buckets of one member vanish, the members of a bucket whose set sizes allow the threshold are
   candidates. Buckets of more than ``block`` members leave the stream as rows and are split into blocks
   that meet each other in separate tasks.
4. Candidates are verified exactly on their shingle sets: by Jaccard similarity, or with ``weights="count"``, where a
   shingle weighs as often as it occurs, by the probability Jaccard similarity that the signature estimates.

:func:`near_duplicate_pairs` expands classes into pairs of records, :func:`near_duplicate_groups`
returns one row a record with its group and its number of linked classes instead.

The chance to miss a pair of similarity s is (1 - s**width)**bands: 1.6 % at s = 0.5 with the
defaults, 0.2 % at 0.55, below 1e-6 at 0.7.

Defined results: rows with null keys, with too few abstract words or no shingle take no part; a null or
blank title counts as none; repeated rows of a key count once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswright.llm.wordseq import U64, mix64, words_of
from corpuswright.operators.skew import skew_join
from corpuswright.session import materialise


SMALL = 1_000_000  # record numbers that are broadcast


class Shingler:
    """Shingle sets as sorted arrays of 64-bit hashes with their counts; word hashes are kept across records."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(words) < self.n:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        ids = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            ids.append(h)
        a = np.array(ids, dtype=U64)
        out = a[: len(a) - self.n + 1].copy()
        for k in range(1, self.n):
            out = mix64(out) + a[k : len(a) - self.n + 1 + k] * U64(2 * k + 1)
        return np.unique(mix64(out), return_counts=True)


def uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 random bits."""
    return ((x >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53


def prob_min_hash(owner: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Signatures [n, registers] of the weighted sets given as (owner, key, weight) entries.

    Every owner has at least one entry. Rounds run over all sets at once; an entry leaves as soon
    as its arrival time passes the latest register of its set.
    """
    q = np.full((n, registers), np.inf)
    flat = q.reshape(-1)
    time = np.zeros(len(keys))
    state = mix64(keys)
    step = 0
    while len(owner):
        step += 1
        bits = mix64(state + U64(step * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(uniform(bits)) / weights
        late = q.max(axis=1)
        go = time < late[owner]
        owner, time, state, weights, bits = owner[go], time[go], state[go], weights[go], bits[go]
        cell = owner * registers + (mix64(bits ^ U64(0xA5A5A5A5A5A5A5A5)) % U64(registers)).astype(np.int64)
        np.minimum.at(flat, cell, time)
    return q


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over common elements i of 1 / sum over j of max(x_j / x_i, y_j / y_i); keys sorted and distinct."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    every = np.union1d(a, b)
    xa, yb = np.zeros(len(every)), np.zeros(len(every))
    xa[np.searchsorted(every, a)], yb[np.searchsorted(every, b)] = wa, wb
    total = 0.0
    for xi, yi in zip(wa[ia], wb[ib]):
        total += 1.0 / np.maximum(xa / xi, yb / yi).sum()
    return total


def shingle_sets(records: DataFrame, n: int, least_words: int, weights: str | None = None, keys_only: bool = False) -> DataFrame:
    """(record_id, key) of each record that takes part, key identifying its set (with counts, if they weigh); or
    (id, shingles, counts) in place of the key."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = Shingler(n)
        for b in batches:
            out = []
            for i, t, a in zip(b["record_id"], b["title"], b["abstract"]):
                body = words_of(a)
                if len(body) >= least_words:
                    x, c = cut(words_of(t) + body)
                    if len(x):
                        c = c.astype(np.int32) if weights else np.zeros(0, dtype=np.int32)
                        out.append((i, xxhash.xxh3_128_digest(x.tobytes() + c.tobytes())) if keys_only else (i, x.view(np.int64), c))
            yield pd.DataFrame(out, columns=["record_id", "key"] if keys_only else ["id", "shingles", "counts"])

    texts = records.select("record_id", "title", "abstract").where("record_id is not null and abstract is not null")
    return texts.mapInPandas(scan, "record_id long, key binary" if keys_only else "id long, shingles array<long>, counts array<int>")


def of_records(records: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Records in (left_semi) or not in (left_anti) ``ids``; up to ``SMALL`` of them travel to the records, beyond that both are shuffled."""
    few = ids.limit(SMALL + 1).count() <= SMALL
    return records.join(F.broadcast(ids) if few else ids, "record_id", how)


def bucket_keys(classes: DataFrame, bands: int, width: int) -> DataFrame:
    """(id, size, bucket): one row for each class and band."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.iloc[lo : lo + 1000]
                lens = part["shingles"].map(len).to_numpy()
                keys = np.concatenate(part["shingles"].to_list()).astype(np.int64).view(U64)
                counts = np.concatenate(part["counts"].to_list()).astype(float)
                weights = counts if len(counts) == len(keys) else np.ones(len(keys))
                q = prob_min_hash(np.repeat(np.arange(len(part)), lens), keys, weights, len(part), bands * width)
                v = q.view(U64).reshape(len(part), bands, width)
                h = np.broadcast_to(np.arange(bands, dtype=U64), (len(part), bands)).copy()
                for k in range(width):
                    h = mix64(h * U64(0x9E3779B97F4A7C15) + v[:, :, k])
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), bands), "size": np.repeat(lens.astype(np.int32), bands), "bucket": h.reshape(-1).view(np.int64)})

    return classes.select("id", "shingles", "counts").mapInPandas(scan, "id long, size int, bucket long")


def run_pairs(ids: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the members of one bucket whose sizes allow the threshold, smaller id first."""
    a, b = np.triu_indices(len(ids), 1)
    fit = (sizes[a] >= threshold * sizes[b]) & (sizes[b] >= threshold * sizes[a]) & (ids[a] != ids[b])
    a, b = ids[a[fit]], ids[b[fit]]
    return np.minimum(a, b), np.maximum(a, b)


def candidates(keys: DataFrame, threshold: float, block: int = 1000) -> DataFrame:
    """(a, b), a < b: classes that share a bucket and whose sizes allow the threshold."""
    ordered = keys.repartition("bucket").sortWithinPartitions("bucket")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of buckets up to ``block`` members (bucket null), the rows of larger ones (b null)."""
        left, crowded = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)), None
        names = ["a", "b", "bucket", "size"]

        def rows(key: np.ndarray, i: np.ndarray, n: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"a": i, "b": pd.array([None] * len(i), dtype="Int64"), "bucket": pd.array(key, dtype="Int64"), "size": n})[names]

        def close(key: np.ndarray, i: np.ndarray, n: np.ndarray, last: bool) -> Iterator[pd.DataFrame]:
            nonlocal left, crowded
            if not len(key):
                return
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[cuts[1:], len(key)]
            keep = len(cuts) if last else len(cuts) - 1  # the last bucket may go on in the next batch
            found_a, found_b = [], []
            lens = ends - cuts
            # buckets of two are the most common by far: all at once
            two = cuts[:keep][lens[:keep] == 2]
            if len(two):
                fit = (n[two] >= threshold * n[two + 1]) & (n[two + 1] >= threshold * n[two]) & (i[two] != i[two + 1])
                two = two[fit]
                found_a.append(np.minimum(i[two], i[two + 1]))
                found_b.append(np.maximum(i[two], i[two + 1]))
            for c, e in zip(cuts[:keep][lens[:keep] > 2], ends[:keep][lens[:keep] > 2]):
                if e - c > block or key[c] == crowded:
                    yield rows(key[c:e], i[c:e], n[c:e])
                else:
                    a, b = run_pairs(i[c:e], n[c:e], threshold)
                    found_a.append(a)
                    found_b.append(b)
            if found_a and sum(map(len, found_a)):
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                pairs = np.unique(np.stack([a, b], axis=1), axis=0)
                yield pd.DataFrame({"a": pairs[:, 0], "b": pd.array(pairs[:, 1], dtype="Int64"), "bucket": pd.array([None] * len(pairs), dtype="Int64"), "size": np.zeros(len(pairs), np.int32)})[names]
            if not last:
                c = cuts[-1]
                if len(key) - c > block:  # never more than a block and a batch in memory
                    crowded = key[c]
                    yield rows(key[c:], i[c:], n[c:])
                    left = (key[:0], i[:0], n[:0])
                else:
                    left = (key[c:], i[c:], n[c:])

        for b in batches:
            key, i, n = b["bucket"].to_numpy(), b["id"].to_numpy(), b["size"].to_numpy()
            if crowded is not None and len(key):
                go = key == crowded
                if go.any():
                    yield rows(key[go], i[go], n[go])
                    key, i, n = key[~go], i[~go], n[~go]
                    if not len(key):
                        continue
                crowded = None
            yield from close(np.r_[left[0], key], np.r_[left[1], i], np.r_[left[2], n], False)
        yield from close(*left, True)

    met = materialise(ordered.mapInPandas(stream, "a long, b long, bucket long, size int"), "met")
    hot = met.where("b is null").select("bucket", F.col("a").alias("id"), "size")
    counts = hot.groupBy("bucket").agg(F.count("*").alias("count"), F.count("*").alias("weight"))
    placed = skew_join(hot, counts, ["bucket"], "weight").withColumn("parts", F.ceil(F.col("count") / block).cast("int"))
    sides = []
    for name in ("a", "b"):
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        both = placed.withColumn("own", part).withColumn("other", other)
        cell = (F.col("own"), F.col("other")) if name == "a" else (F.col("other"), F.col("own"))
        sides.append(both.select("bucket", cell[0].alias("x"), cell[1].alias("y"), F.col("id").alias(name), F.col("size").alias(f"size_{name}")))
    fit = (F.col("size_a") >= threshold * F.col("size_b")) & (F.col("size_b") >= threshold * F.col("size_a"))
    crossed = sides[0].join(sides[1], ["bucket", "x", "y"]).where((F.col("a") < F.col("b")) & fit).select("a", "b")
    return met.where("b is not null").select("a", "b").unionByName(crossed).distinct()


def near_duplicate_classes(records: DataFrame, n: int = 5, threshold: float = 0.8, least_words: int = 20, bands: int = 64, width: int = 4, weights: str | None = None, block: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, record_id) of each class of equal sets, and verified (a, b) between classes."""
    records = records.select("record_id", "title", "abstract")
    keys = materialise(shingle_sets(records, n, least_words, weights, keys_only=True), "keys")
    classes = keys.groupBy("key").agg(F.min("record_id").alias("id"))
    members = materialise(keys.join(classes, "key").select("id", "record_id").distinct(), "members")
    copies = materialise(members.where("id <> record_id").select("record_id").distinct(), "copies")
    # sets are made anew from the texts where they are needed: they take more room than the texts
    chosen = shingle_sets(of_records(records, copies, "left_anti"), n, least_words, weights)
    # set sizes need not be comparable where counts weigh
    found = materialise(candidates(bucket_keys(chosen, bands, width), 0.0 if weights else threshold, block), "found")
    ends = materialise(found.select(F.col("a").alias("record_id")).unionByName(found.select(F.col("b").alias("record_id"))).distinct(), "ends")
    needed = materialise(shingle_sets(of_records(records, ends, "left_semi"), n, least_words, weights), "needed")
    left, right = (needed.select(F.col("id").alias(k), F.col("shingles").alias(f"set_{k}"), F.col("counts").alias(f"n_{k}")) for k in "ab")
    met = found.join(left, "a").join(right, "b")
    if weights:
        similar = F.pandas_udf(lambda a, x, b, y: pd.Series([probability_jaccard(p, q.astype(float), r, t.astype(float)) for p, q, r, t in zip(a, x, b, y)], dtype=float), "double")
        return members, met.where(similar("set_a", "n_a", "set_b", "n_b") >= threshold - 1e-9).select("a", "b").distinct()
    both = F.size(F.array_intersect("set_a", "set_b"))
    scored = met.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b") - both).alias("any"))
    return members, scored.where(F.col("both") >= threshold * F.col("any") - 1e-9).select("a", "b").distinct()


def near_duplicate_pairs(records: DataFrame, **options) -> DataFrame:
    """(record_id_a, record_id_b), smaller first: every pair of records that reaches the threshold."""
    members, links = near_duplicate_classes(records, **options)
    a, b = (members.select(F.col("id").alias(k), F.col("record_id").alias(f"record_id_{k}")) for k in "ab")
    across = links.join(a, "a").join(b, "b").select("record_id_a", "record_id_b")
    within = a.join(b.withColumnRenamed("b", "a"), "a").where("record_id_a < record_id_b").select("record_id_a", "record_id_b")
    x, y = F.col("record_id_a"), F.col("record_id_b")
    return across.select(F.least(x, y).alias("record_id_a"), F.greatest(x, y).alias("record_id_b")).unionByName(within).distinct()


def near_duplicate_groups(records: DataFrame, **options) -> DataFrame:
    """(record_id, group_id, links): the connected group of each record that takes part, named by
    its smallest record, and the number of other classes its class is linked to. Copies of one
    text share a row's class and are not expanded into pairs."""
    from corpuswright.operators.graph import components

    members, links = near_duplicate_classes(records, **options)
    links = materialise(links, "links")
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("links"))
    group = components(links, "a", "b").withColumnRenamed("node", "id")
    out = members.join(group, "id", "left").join(degree, "id", "left")
    return out.select("record_id", F.coalesce("component", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
