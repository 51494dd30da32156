"""Long exact spans shared between records: Count-min prefilter, then exact grouping.

Problem 8. For each document the maximal stretches in which every character lies in a span of at
least ``length`` characters that also occurs, character for character, in another document.

How it works
------------
A document of n characters has n - length + 1 windows, far too many to shuffle. Each window is
represented by an *anchor*: the gram of ``gram`` characters in it whose hash is smallest (ties
keep all). The choice depends on the window's characters alone, so equal windows have equal
anchors at equal offsets, and about one gram in (length - gram) / 2 becomes an anchor.

1. First pass over the texts: each partition counts its anchors' hashes in a Count-min sketch
   of two rows that saturate at two, kept sparse; the sketches are merged block by block into one of bounded
   width (about four cells an anchor up to ``max_bits``; wider data make it let more through, which costs
   shuffle and changes no row). An estimate is never below the true count, so no repeated window is lost.
2. Second pass: only anchors estimated repeated leave the scan, each with the hash of its
   *context*, the stretch that holds every window the anchor can stand for. They are grouped
   exactly, by (anchor, context) and then by anchor, with partial aggregation before the shuffle;
   no group is ever collected. Anchors in one document only end here.
3. A context found in two documents settles all its windows at once. Where one anchor has several
   contexts (the ends of shared spans), one representative of each writes its windows, which are
   grouped exactly by their own hash.
4. Settled windows go back to the occurrences of their context. Contexts with very many
   occurrences (at most ``hot_keys`` can exist) travel as a broadcast, the rest by shuffle. The
   windows of a document are merged into maximal stretches.

Window and context hashes have 64 bits and are compared together with the anchor's own 64 bits.

Defined results: null and empty texts and texts shorter than ``length`` give no row; a text that
repeats only within itself gives none; repeated rows of one doc_id count as one document; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswright.llm.wordseq import U64, mix64
from corpuswright.operators.skew import skew_join
from corpuswright.session import materialise

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 15
SMALL = 1_000_000  # document numbers that are broadcast to filter texts


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=U64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U64)


class Hasher:
    """Hashes of all stretches of a batch of texts, from one running sum of weighted characters."""

    def __init__(self, texts: list[str]):
        raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        self.lens = np.array([len(r) for r in raw], dtype=np.int64)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        chars = np.concatenate(raw) if raw else np.zeros(0, np.uint32)
        n = len(chars)
        self.up, self.down = powers(BASE, n), powers(INVERSE, n + 1)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((chars.astype(U64) + U64(0x5851F42D)) * self.up, out=sums[1:])
        self.sums = sums

    def grams(self, size: int) -> np.ndarray:
        return mix64((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])

    def at(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix64((self.sums[hi] - self.sums[lo]) * self.down[lo])


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of ``width`` values, by doubling."""
    have, done = x, 1
    while done * 2 <= width:
        have = op(have[:-done], have[done:])
        done *= 2
    rest = width - done
    return op(have[: len(have) - rest], have[rest:]) if rest else have


def anchors(h: Hasher, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the batch, hashes) of every gram that is the smallest of some window."""
    width = length - gram + 1
    if h.sums.size - 1 < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    g = h.grams(gram)
    # a window must not reach over the end of its text: windows that do are set aside
    low = sliding(g, width, np.minimum)
    inside = np.zeros(len(h.sums), dtype=bool)
    for s, e in zip(h.starts, h.ends):
        if e - s >= length:
            inside[s : e - length + 1] = True
    low = np.where(inside[: len(low)], low, U64(0))
    pad = np.zeros(width - 1, dtype=U64)
    best = sliding(np.concatenate([pad, low, pad]), width, np.maximum)
    at = np.flatnonzero((best == g) & (best > 0))
    return at, g[at]


class Sketch:
    """Count-min with counters 0, 1, 2+, sparse: the cells of each row seen once and seen more often."""

    def __init__(self, bits: int, rows: int = 2):
        self.bits, self.rows = bits, rows
        self.parts: list[list[np.ndarray]] = [[] for _ in range(rows)]
        self.size = 0

    @staticmethod
    def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
        return (mix64(keys + U64((row + 1) * 0x632BE59BD9B4E019 % 2**64)) >> U64(64 - bits)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        for r in range(self.rows):
            self.parts[r].append(self.cells(keys, r, self.bits))
        self.size += len(keys)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """Non-empty blocks, as bit planes of what was seen and what was seen again, compressed; the sketch is empty then."""
        for r in range(self.rows):
            if not self.parts[r]:
                continue
            cell, n = np.unique(np.concatenate(self.parts[r]), return_counts=True)
            width = min(BLOCK * 8, 1 << self.bits)
            block = cell // width
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(cell) else np.zeros(0, np.int64)
            for c, e in zip(cuts, np.r_[cuts[1:], len(cell)]):
                one, two = np.zeros(width, dtype=bool), np.zeros(width, dtype=bool)
                one[cell[c:e] % width] = True
                two[cell[c:e][n[c:e] > 1] % width] = True
                yield (r << 40) | int(block[c]) * width, zlib.compress(np.packbits(one).tobytes() + np.packbits(two).tobytes(), 1)
            self.parts[r] = []
        self.size = 0


def merged(parts: list[bytes]) -> bytes:
    """Counters of one block, added and saturated."""
    one = two = None
    for p in parts:
        raw = np.frombuffer(zlib.decompress(p), dtype=np.uint8)
        a, b = raw[: len(raw) // 2], raw[len(raw) // 2 :]
        if one is None:
            one, two = a.copy(), b.copy()
        else:
            two |= b | (one & a)
            one |= a
    return zlib.compress(one.tobytes() + two.tobytes(), 1)


def seen_again(part: bytes) -> bytes:
    """The plane of what was seen more than once, of a merged block."""
    raw = zlib.decompress(part)
    return zlib.compress(raw[len(raw) // 2 :], 1)


def repeated_filter(rows: list[tuple[int, bytes]], bits: int, depth: int) -> list[np.ndarray]:
    """Packed ``two`` plane of each row."""
    planes = [np.zeros(max(1, (1 << bits) // 8), dtype=np.uint8) for _ in range(depth)]
    for key, part in rows:
        raw = np.frombuffer(zlib.decompress(part), dtype=np.uint8)
        at = (key & (1 << 40) - 1) // 8
        planes[key >> 40][at : at + len(raw)] = raw
    return planes


def estimated_repeated(keys: np.ndarray, planes: list[np.ndarray], bits: int) -> np.ndarray:
    keep = np.ones(len(keys), dtype=bool)
    for r, p in enumerate(planes):
        c = Sketch.cells(keys, r, bits)
        keep &= (p[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return keep


def chunks(texts: list[str], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters: bounds memory, whatever the lengths."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def context_windows(ctx: list[str], group: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every window of each context: (row, start in the context, window hash, hash with its group)."""
    h = Hasher(ctx)
    per = np.maximum(h.lens - length + 1, 0)
    row = np.repeat(np.arange(len(ctx)), per)
    start = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    at = h.starts[row] + start
    w = h.at(at, at + length)
    return row, start, w, mix64(w ^ group[row].astype(U64) * U64(0xD6E8FEB86659FD93))


def runs_of(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring starts of a row joined: (row, first, last); input sorted by row, start."""
    if not len(row):
        return row, start, start
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
    end = np.r_[new[1:] - 1, len(row) - 1]
    return row[new], start[new], start[end]


def shared_spans(documents: DataFrame, length: int = 320, gram: int | None = None, max_bits: int = 29, small_group: int = 64, hot_keys: int = 1000) -> DataFrame:
    """(doc_id, start_char, end_char): the maximal stretches shared with another document."""
    spark = documents.sparkSession
    gram = gram or max(1, length * 3 // 4)
    back = length - gram
    texts = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= length))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = int(min(max_bits, max(18, np.ceil(np.log2(chars / (back / 2 + 1) * 4 + 2)))))
    depth = 2

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = Sketch(bits, depth)
        for b in batches:
            t = b["text"].tolist()
            for lo, hi in chunks(t):
                h = Hasher(t[lo:hi])
                at, g = anchors(h, length, gram)
                # a document counts once for each hash
                d = np.searchsorted(h.ends, at, side="right")
                sketch.add(pd.DataFrame({"d": d, "g": g}).drop_duplicates()["g"].to_numpy())
                if sketch.size > 4_000_000:  # bounds a task's memory; blocks are merged anyway
                    for key, part in sketch.blocks():
                        yield pd.DataFrame({"key": [key], "part": [part]})
        for key, part in sketch.blocks():
            yield pd.DataFrame({"key": [key], "part": [part]})

    def merge(part: pd.Series) -> bytes:
        return merged(part.tolist())

    merge_udf = F.pandas_udf(merge, "binary")
    parts = texts.select("text").mapInPandas(count, "key long, part binary").withColumn("salt", F.spark_partition_id() % 32)
    sketch = parts.groupBy("key", "salt").agg(merge_udf("part").alias("part")).groupBy("key").agg(merge_udf("part").alias("part"))
    # only what was seen again goes to the driver: at most 2 ** max_bits / 8 bytes a row of the sketch
    again = F.pandas_udf(lambda part: part.map(seen_again), "binary")
    planes = spark.sparkContext.broadcast(repeated_filter([(r.key, bytes(r.part)) for r in sketch.select("key", again("part").alias("part")).collect()], bits, depth))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep = planes.value
        for b in batches:
            ids, t = b["doc_id"].to_numpy(), b["text"].tolist()
            for lo, hi in chunks(t):
                h = Hasher(t[lo:hi])
                at, g = anchors(h, length, gram)
                ok = estimated_repeated(g, keep, bits)
                at, g = at[ok], g[ok]
                d = np.searchsorted(h.ends, at, side="right")
                s, e = np.maximum(at - back, h.starts[d]), np.minimum(at + length, h.ends[d])
                c = h.at(s, e) ^ mix64(((at - s) * 4 * length + (e - at)).astype(U64))
                yield pd.DataFrame({"doc_id": ids[lo + d], "pos": at - h.starts[d], "left": at - s, "size": e - s, "h": g.view(np.int64), "ctx": c.view(np.int64)})

    found = materialise(texts.mapInPandas(second, "doc_id long, pos long, left int, size int, h long, ctx long"), "anchors")
    by_ctx = found.groupBy("h", "ctx").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"),
        F.min(F.struct("doc_id", "pos", "left", "size")).alias("rep"),
    )
    by_anchor = by_ctx.groupBy("h").agg(F.min("lo").alias("all_lo"), F.max("hi").alias("all_hi"), F.count("*").alias("contexts")).where("all_lo < all_hi")
    total = found.count()
    repeated = skew_join(by_ctx, by_anchor.select("h", "contexts", F.col("contexts").alias("weight")), ["h"], "weight", total, hot_keys)
    repeated = materialise(repeated, "contexts")

    # settled at once: the whole context is in two documents
    whole = repeated.where("lo < hi").select("h", "ctx", "n", F.lit(0).alias("first"), (F.col("rep.size") - length).alias("last"))
    open_ = repeated.where("contexts > 1").select("h", "ctx", "n", "lo", "hi", "contexts", F.col("rep.doc_id").alias("doc_id"), F.col("rep.pos").alias("pos"), F.col("rep.left").alias("left"), F.col("rep.size").alias("size"))
    open_ = materialise(open_, "open")
    count = open_.count()
    if count <= 50_000:  # at most some MB: the texts stay where they are
        from_texts = texts.join(F.broadcast(open_), "doc_id")
    else:
        docs = open_.select("doc_id").distinct()
        few = docs.limit(SMALL + 1).count() <= SMALL
        from_texts = (texts.join(F.broadcast(docs), "doc_id", "left_semi") if few else texts).join(open_, "doc_id")
    with_text = materialise(from_texts.select("h", "ctx", "n", "lo", "hi", "contexts", "left", F.expr("substring(text, cast(pos - left + 1 as int), size)").alias("t")).where(F.length("t") == F.col("size")), "edges")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Windows of the contexts of one anchor against each other; a row holds a whole anchor."""
        for b in batches:
            flat = [(i, m) for i, ms in enumerate(b["members"]) for m in ms]
            if not flat:
                continue
            group = np.array([i for i, _ in flat], dtype=np.int64)
            lo, hi = (np.array([m[k] for _, m in flat], dtype=np.int64) for k in ("lo", "hi"))
            ctx, n = (np.array([m[k] for _, m in flat], dtype=np.int64) for k in ("ctx", "n"))
            row, start, _, key = context_windows([m["t"] for _, m in flat], group, ctx, length)
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            a, z = np.minimum.reduceat(lo[row[order]], cuts), np.maximum.reduceat(hi[row[order]], cuts)
            good = np.zeros(len(key), dtype=bool)
            good[order] = np.repeat(a < z, np.diff(np.r_[cuts, len(key)]))
            good &= (lo == hi)[row]  # the others are settled already
            r, f, l = runs_of(row[good], start[good])
            yield pd.DataFrame({"h": b["h"].to_numpy()[group[r]], "ctx": ctx[r], "n": n[r], "first": f.astype(np.int32), "last": l.astype(np.int32)})

    out = "h long, ctx long, n long, first int, last int"
    small = with_text.where(F.col("contexts") <= small_group).groupBy("h").agg(F.collect_list(F.struct("ctx", "n", "lo", "hi", "t")).alias("members")).mapInPandas(compare, out)

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Anchors with many contexts: each window becomes a row of its own."""
        for b in batches:
            h, ctx, n, lo, hi, t = (b[c] for c in ("h", "ctx", "n", "lo", "hi", "t"))
            row, start, w, _ = context_windows(t.tolist(), np.zeros(len(b), np.int64), ctx.to_numpy(), length)
            yield pd.DataFrame({"h": h.to_numpy()[row], "ctx": ctx.to_numpy()[row], "n": n.to_numpy()[row], "lo": lo.to_numpy()[row], "hi": hi.to_numpy()[row], "start": start.astype(np.int32), "w": w.view(np.int64)})

    crowded = with_text.where(F.col("contexts") > small_group).select("h", "ctx", "n", "lo", "hi", "t")
    windows = materialise(crowded.mapInPandas(explode, "h long, ctx long, n long, lo long, hi long, start int, w long"), "crowded")
    twice = windows.groupBy("h", "w").agg(F.min("lo").alias("a"), F.max("hi").alias("z"), F.count("*").alias("weight")).where("a < z").select("h", "w", "weight")
    many = skew_join(windows.where("lo = hi"), twice, ["h", "w"], "weight", windows.count(), hot_keys).select("h", "ctx", "n", F.col("start").alias("first"), F.col("start").alias("last"))

    settled = materialise(whole.unionByName(small).unionByName(many), "windows")
    hits = skew_join(found, settled, ["h", "ctx"], "n", total, hot_keys)
    start = F.col("pos") - F.col("left") + F.col("first")
    spans = hits.select("doc_id", start.alias("s"), (F.col("pos") - F.col("left") + F.col("last") + length).alias("e")).groupBy("doc_id", "s").agg(F.max("e").alias("e"))
    return islands(spans)


def islands(spans: DataFrame) -> DataFrame:
    """Overlapping or touching [s, e) of a doc_id joined."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reach >= F.col("s"), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return marked.groupBy("doc_id", "island").agg(F.min("s").cast("int").alias("start_char"), F.max("e").cast("int").alias("end_char")).drop("island")
