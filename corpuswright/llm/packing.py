"""Texts into fixed-capacity windows: minimum bin slack over length counts.

Problem 6. Every text, measured in tokens, goes into windows of fixed capacity with little unused
room; only a text larger than the capacity is divided, into full pieces and a rest.

How it works
------------
1. Texts become token counts in Arrow batches (one pass, whatever the number of capacities).
2. Only the *number of texts of each length* matters for the plan, and there are at most
   ``capacity`` lengths: the histogram is aggregated before the shuffle, and each capacity's plan
   is made in one task of bounded size.
3. A plan is a list of patterns. The longest remaining length opens a window; a bitset dynamic
   program over the remaining-length multiset finds the sum closest to the capacity, and
   backtracking yields how many items of each length it takes. The pattern is then repeated as
   often as the counts allow, so the number of patterns follows the number of distinct lengths
   and not the number of texts.
4. Texts take their places in the plan by their rank among the texts of equal length. Ranks are
   computed in salted slices with offsets from the counts, so a length that a third of all texts
   share is never sorted in one task.

Defined results: a null text is no text and gets no row; an empty text has 0 tokens and lies at
the start of the window of its capacity's first pattern; equal texts are separate items; rows with a null
doc_id are left out; rows that repeat a doc_id are items of their own and differ by nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuswright.session import materialise

SMALL = 1000  # kinds of windows
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the byte-level rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str):
    """A public byte-level tokenizer from its rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of each text."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": np.array([len(enc.encode_ordinary(t)) for t in b["text"]], dtype=np.int64)})

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(scan, "doc_id long, tokens long")


def fill(counts: dict[int, int], lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Multiset (length, times) opened by the longest length whose sum is closest to the capacity.

    Bit s of a state says that some multiset sums to s. Lengths join from the longest down, their
    counts in powers of two; the states passed are what backtracking walks over.
    """
    first = lengths[0]
    room = capacity - first
    mask = (1 << room + 1) - 1
    state, passed = 1, []
    for n in lengths:
        if n > room:
            continue
        left = min(counts[n] - (n == first), room // n)
        times = 1
        while left > 0:
            take = min(times, left)
            grown = (state | state << n * take) & mask
            passed.append((state, n, take))
            state = grown
            left -= take
            times *= 2
        if state >> room & 1:
            break
    total = state.bit_length() - 1
    out: dict[int, int] = {first: 1}
    for before, n, take in reversed(passed):
        if not before >> total & 1:
            total -= n * take
            out[n] = out.get(n, 0) + take
    return sorted(out.items(), reverse=True)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, times in a window, first window, windows) for every use of a length."""
    left = {n: c for n, c in counts.items() if 0 < n <= capacity and c > 0}
    used = dict.fromkeys(left, 0)
    lengths = sorted(left, reverse=True)
    bins, out = 0, []
    while lengths:
        pattern = fill(left, lengths, capacity)
        repeat = min(left[n] // times for n, times in pattern)
        for n, times in pattern:
            out.append((n, used[n], times, bins, repeat))
            used[n] += times * repeat
            left[n] -= times * repeat
        bins += repeat
        lengths = [n for n in lengths if left[n]]
    if counts.get(0):
        out.append((0, 0, counts[0], 0, 1))
    return out


def pack(counts: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_id, bin_id, doc_id, piece_no, start_token, end_token) for each piece of each text.

    ``counts``: (doc_id, tokens); ``windows``: (window_id, capacity_tokens), a small fixed table.
    Windows with a null or non-positive capacity hold nothing and get no row.
    """
    caps = [(r[0], r[1]) for r in windows.where("capacity_tokens > 0").select("window_id", "capacity_tokens").distinct().limit(SMALL + 1).collect()]
    if len(caps) > SMALL:
        raise ValueError(f"more than {SMALL} windows")
    spark = counts.sparkSession
    if not caps:
        return spark.createDataFrame([], "window_id int, bin_id long, doc_id long, piece_no int, start_token long, end_token long")
    each = F.explode(F.array(*[F.struct(F.lit(w).cast("int").alias("window_id"), F.lit(c).cast("int").alias("cap")) for w, c in caps]))
    last = F.greatest(F.lit(0), F.ceil(F.col("tokens") / F.col("cap")) - 1).cast("int")
    pieces = counts.select("doc_id", "tokens", each.alias("w")).select("doc_id", "tokens", "w.*").withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece_no").cast("long") * F.col("cap")
    pieces = pieces.select("window_id", "cap", "doc_id", "piece_no", start.alias("start_token"), F.least(F.col("tokens"), start + F.col("cap")).alias("end_token"))
    pieces = pieces.withColumn("len", (F.col("end_token") - F.col("start_token")).cast("int"))
    total = counts.count()
    slices = max(8, total // 200_000 + 1)
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(slices)).cast("int"))

    histogram = materialise(pieces.groupBy("window_id", "cap", "len", "slice").agg(F.count("*").alias("n")), "lengths")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("window_id", "len").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = histogram.select("window_id", "len", "slice", before.alias("offset"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = plan(dict(zip(pdf["len"].tolist(), pdf["n"].tolist())), int(pdf["cap"].iloc[0]))
        out = pd.DataFrame(rows, columns=["len", "rank", "times", "bin", "repeat"])
        out.insert(0, "window_id", int(pdf["window_id"].iloc[0]))
        return out

    by_length = histogram.groupBy("window_id", "cap", "len").agg(F.sum("n").alias("n"))
    made = by_length.groupBy("window_id").applyInPandas(make, "window_id int, len int, rank long, times long, bin long, repeat long").toPandas()
    # bounded by the capacities: a use for each of at most cap lengths in each of its patterns
    uses = {k: g.sort_values("rank") for k, g in made.groupby(["window_id", "len"])}
    shared = spark.sparkContext.broadcast({k: tuple(g[c].to_numpy(dtype=np.int64) for c in ("rank", "times", "bin")) for k, g in uses.items()})

    order = Window.partitionBy("window_id", "len", "slice").orderBy("doc_id", "piece_no")
    ranked = pieces.withColumn("row", F.row_number().over(order) - 1).join(offsets, ["window_id", "len", "slice"])
    ranked = ranked.select("window_id", "doc_id", "piece_no", "start_token", "end_token", "len", (F.col("offset") + F.col("row")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for b in batches:
            bins = np.zeros(len(b), dtype=np.int64)
            for key, at in b.groupby(["window_id", "len"]).indices.items():
                first, times, start = table[key]
                rank = b["rank"].to_numpy()[at]
                use = np.searchsorted(first, rank, side="right") - 1
                bins[at] = start[use] + (rank - first[use]) // times[use]
            yield b.assign(bin_id=bins)[["window_id", "bin_id", "doc_id", "piece_no", "start_token", "end_token"]]

    return ranked.mapInPandas(place, "window_id int, bin_id long, doc_id long, piece_no int, start_token long, end_token long")
