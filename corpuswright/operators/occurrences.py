"""Which of many sentences occur, character for character, in the texts of their key.

Pairs of a sentence and a text are never formed, so the work grows with the characters of both and
not with the product of a key's sentences and texts.

1. Every sentence puts the hashes of some of its beginnings, with its key, into one plane of bits:
   those of 8, 16, 32, ... bytes (of 1, 2 or 4 for shorter ones), then the rest of its length by falling
   powers of two, and a mark at its whole length. Hashes of any stretch come from one running sum.
2. The texts are scanned where they lie. From each character the same steps are taken as long as
   the plane has the beginning; what stands under a mark leaves the scan, as text.
3. So what comes out stands in a text of its key by construction, and nothing that is a sentence is
   missed: the plane only ever lets too much through, and an equality join removes that.

The plane ends at 2 ** max_bits bits. More sentences than that serves go through it in slices by key; a
text then meets the slice of its key alone, only keys with a quarter of a slice or more are in all slices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
ENTRY = 3  # beginnings start at 2 ** ENTRY bytes
BLOCK = 1 << 15  # bytes of the plane in a row
PIECE = 1 << 19  # bytes of text at a time
WIDE = 1 << 20  # beginnings at a time
ROOM = 16  # cells for each beginning


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


LETTERS = mixed(np.arange(1, 257, dtype=U64) * U64(BASE))


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


class Stretches:
    """Hashes of stretches of bytes of a run of rows, each with the hash of its row's key."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, keys: np.ndarray):
        n = len(raw)
        room = 1 << max(20, n.bit_length())
        self.starts, self.ends, self.keys = offsets[:-1], offsets[1:], keys.view(U64)
        self.down = powers(pow(BASE, -1, 1 << 64), room)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(LETTERS[raw] * powers(BASE, room)[:n], out=self.sums[1:])

    def at(self, row: np.ndarray, pos: np.ndarray, size: np.ndarray, whole: bool = False) -> np.ndarray:
        h = (self.sums[pos + size] - self.sums[pos]) * self.down[pos]
        return mixed(h ^ mixed(self.keys[row] + size.astype(U64) * U64(2) + U64(whole)))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Stretches]]:
    """Rows (key, hash, text) in runs of about PIECE bytes: (rows, their bytes, their stretches)."""
    for b in batches:
        t = b.column("text").cast(pa.large_string())
        _, offsets, data = t.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[t.offset : t.offset + len(t) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        keys = b.column("hash").to_numpy()
        lo = 0
        while lo < len(t):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, side="right")) - 1)
            part = raw[offsets[lo] : offsets[hi]]
            yield b.slice(lo, hi - lo), part, Stretches(part, offsets[lo : hi + 1] - offsets[lo], keys[lo:hi])
            lo = hi


def cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> U64(64 - bits)).astype(np.int64), (mixed(h + U64(BASE)) >> U64(64 - bits)).astype(np.int64)


def beginnings(s: Stretches) -> Iterator[np.ndarray]:
    """The hashes that the rows put into the plane."""
    row, size = np.arange(len(s.starts)), s.ends - s.starts
    yield s.at(row, s.starts, size, True)
    top = np.frexp(size)[1] - 1
    for j in range(int(top.max(initial=-1)) + 1):
        on = row[(top >= j) if j >= ENTRY else (top == j)]
        yield s.at(on, s.starts[on], np.full(len(on), 1 << j))
    done = np.where(size > 0, 1 << np.maximum(top, 0), 0)
    for bit in range(int(top.max(initial=0)) - 1, -1, -1):
        on = row[(size >> bit & 1 == 1) & (top > bit)]
        done[on] += 1 << bit
        yield s.at(on, s.starts[on], done[on])


class Plane:
    """Bits of which each beginning sets two."""

    def __init__(self, bits: int, rows: list[tuple[int, bytes]] = ()):
        self.bits, self.data = bits, np.zeros((1 << bits) // 8, dtype=np.uint8)
        for block, part in rows:
            raw = np.frombuffer(zlib.decompress(part), dtype=np.uint8)
            self.data[block * BLOCK : block * BLOCK + len(raw)] = raw

    def add(self, h: np.ndarray) -> None:
        for c in cells(h, self.bits):
            np.bitwise_or.at(self.data, c >> 3, (1 << (c & 7)).astype(np.uint8))

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        for k in range(0, len(self.data), BLOCK):
            if self.data[k : k + BLOCK].any():
                yield k // BLOCK, zlib.compress(self.data[k : k + BLOCK].tobytes(), 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        one = (h >> U64(64 - self.bits)).astype(np.int64)
        on = np.flatnonzero(self.data[one >> 3] >> (one & 7).astype(np.uint8) & 1)
        two = cells(h[on], self.bits)[1]
        return on[self.data[two >> 3] >> (two & 7).astype(np.uint8) & 1 == 1]


def merged(parts: list[bytes]) -> bytes:
    out = np.frombuffer(zlib.decompress(parts[0]), dtype=np.uint8)
    for p in parts[1:]:
        out = out | np.frombuffer(zlib.decompress(p), dtype=np.uint8)
    return zlib.compress(out.tobytes(), 1)


Spots = tuple[np.ndarray, np.ndarray, np.ndarray]  # row, position, size


def longer(s: Stretches, plane: Plane, spots: Spots, more: np.ndarray | int) -> Spots:
    """The spots that have, ``more`` bytes on, a beginning in the plane."""
    row, pos, size = spots
    size = size + more
    fit = np.flatnonzero(pos + size <= s.ends[row])
    row, pos, size = row[fit], pos[fit], size[fit]
    on = plane.has(s.at(row, pos, size))
    return row[on], pos[on], size[on]


def joined(*spots: Spots) -> Spots:
    return tuple(np.concatenate(x) for x in zip(*spots))


def walk(s: Stretches, plane: Plane, spots: Spots, bit: int, entering: dict[int, Spots]) -> Iterator[Spots]:
    """All spots that the steps below 2 ** (bit + 1) lead to, at most WIDE at a time."""
    for k in range(bit, -1, -1):
        if k + 1 in entering:
            spots = joined(spots, entering[k + 1])
        if len(spots[0]) > WIDE:
            for lo in range(0, len(spots[0]), WIDE // 2):
                yield from walk(s, plane, tuple(x[lo : lo + WIDE // 2] for x in spots), k, {})
            spots = tuple(x[:0] for x in spots)
        spots = joined(spots, longer(s, plane, spots, 1 << k))
    yield joined(spots, entering[0]) if 0 in entering else spots


def marked(s: Stretches, raw: np.ndarray, plane: Plane, sizes: list[int]) -> Iterator[Spots]:
    """Spots of the run under a mark, each (key, text) once in what is yielded. ``sizes``: exponents of the first beginnings."""
    first = np.flatnonzero(raw & 0xC0 != 0x80)
    row = np.repeat(np.arange(len(s.starts)), s.ends - s.starts)[first]
    every = (row, first, np.zeros(len(first), dtype=np.int64))
    lines = np.arange(len(s.starts))
    entering = {j: longer(s, plane, every, 1 << j) for j in sizes if j <= ENTRY}
    for j in sizes:
        if j > ENTRY:
            entering[j] = longer(s, plane, entering[j - 1], 1 << (j - 1))
    nothing = tuple(x[:0] for x in every)
    edge = np.append(raw & 0xC0 != 0x80, True)
    blank = (lines, s.starts, np.zeros(len(lines), dtype=np.int64))
    for row, pos, size in (blank, *walk(s, plane, nothing, max(sizes, default=0) - 1, entering)):
        whole = np.flatnonzero(edge[pos + size])
        h = s.at(row[whole], pos[whole], size[whole], True)
        on = plane.has(h)
        on = whole[on[np.unique(h[on], return_index=True)[1]]]
        yield row[on], pos[on], size[on]


def occurring(sentences: DataFrame, texts: DataFrame, key: str, sentence: str, text: str, max_bits: int = 29) -> DataFrame:
    """(key, sentence), each once: stretches of the texts of a key, among them every sentence of that key that occurs in one.

    What is no sentence of the key may be among them: join by equality. '' occurs in every text; null
    keys, sentences and texts give nothing.
    """
    spark = sentences.sparkSession
    hashed = lambda df, c: df.where(F.col(key).isNotNull() & F.col(c).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(key).alias("hash"), F.col(c).alias("text"))
    given, scanned = hashed(sentences, sentence), hashed(texts, text)
    size = F.octet_length("text")
    # at most: doubled beginnings, a rest of as many powers, the mark
    steps = F.when(size > 0, 2 * F.floor(F.log2(size)) + 2).otherwise(1)
    seen = given.agg(F.sum(steps).alias("steps"), F.max(size).alias("most"), *[F.count_if((size >= 1 << j) & (size < 2 << j)).alias(f"n{j}") for j in range(ENTRY)]).first()
    total, top = seen.steps or 0, (seen.most or 0).bit_length() - 1
    sizes = [j for j in range(ENTRY) if seen[f"n{j}"]] + list(range(ENTRY, top + 1))
    bits = min(max_bits, max(18, (total * ROOM).bit_length()))
    slices = -(-total * ROOM // (2 << max_bits))
    hot: list[str] = []
    if slices > 1:
        hot = [r.key for r in given.groupBy("key").agg(F.sum(steps).alias("n")).where(F.col("n") > total // slices // 4).collect()]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = Plane(bits)
        for _, _, s in pieces(batches):
            for h in beginnings(s):
                plane.add(h)
        for block, part in plane.blocks():
            yield pa.RecordBatch.from_pydict({"block": [block], "part": [part]})

    def merge_parts(part: pd.Series) -> bytes:
        return merged(part.tolist())

    merge = F.pandas_udf(merge_parts, "binary")

    def scan(plane_of, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = plane_of.value
        for rows, raw, s in pieces(batches):
            for row, pos, n in marked(s, raw, plane, sizes):
                if len(row):
                    found = [raw[p : p + k].tobytes() for p, k in zip(pos.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([rows.column("key").take(pa.array(row)), pa.array(found, pa.binary()).cast(pa.string())], ["key", "text"])

    def pass_of(given: DataFrame, scanned: DataFrame) -> DataFrame:
        parts = given.select("hash", "text").mapInArrow(gather, "block long, part binary").withColumn("salt", F.spark_partition_id() % 32)
        parts = parts.groupBy("block", "salt").agg(merge("part").alias("part")).groupBy("block").agg(merge("part").alias("part"))
        plane = spark.sparkContext.broadcast(Plane(bits, [(r.block, bytes(r.part)) for r in parts.collect()]))
        return scanned.mapInArrow(lambda batches: scan(plane, batches), "key string, text string")

    if slices <= 1:
        out = pass_of(given, scanned)
    else:
        crowded, mine = F.col("key").isin(hot) if hot else F.lit(False), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(slices))
        of = F.when(crowded, F.pmod(F.xxhash64("text"), F.lit(slices))).otherwise(mine)
        passes = [pass_of(given.where(of == k), scanned.where(crowded | (mine == k))) for k in range(slices)]
        out = passes[0]
        for p in passes[1:]:
            out = out.unionByName(p)
    return out.distinct().select(F.col("key").alias(key), F.col("text").alias(sentence))
