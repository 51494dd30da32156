"""Evaluation texts inside a corpus: Wu-Manber search over word identifiers.

Problem 7. A document leaks an item if it holds ``run`` consecutive words of the item (an item
shorter than that can only leak the other way), or at least ``share`` of the item's words in
their order within a stretch of at most ``spread`` times the item's number of words.

How it works
------------
The held-out items are compiled into :class:`Matcher` tables, in sets of at most ``per_set`` words, and broadcast.
Documents stream through ``mapInPandas`` in Arrow batches: no shuffle of texts, no state, nothing collected.

* Patterns of the first rule are all ``run``-word windows of the items. A block is two neighbouring words; the
  shift table gives for each block how far the window may jump, blocks in no pattern allow the
  longest jump, and a zero shift leads to the bucket of patterns with that suffix block, whose
  members are compared word by word. All texts of a batch advance in lock step, one vectorised
  jump a round.
* The ``share`` rule allows edits between any two words, so no window of several words survives whole. Its patterns
  are the neighbouring word pairs of the items with up to two words between them: an item of L words of which n must
  match within S words keeps at least 2n - L - 1 - floor((S - n) / 3) such pairs within the stretch. Texts that
  hold so many of an item's pairs so close together are decided exactly by longest common subsequence. Items too short
  to keep a pair are looked for by their rarest words.

Defined results: null, empty and wordless texts give no row; an item without words or without item_id gives none;
repeated rows of one doc_id give one row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswright.llm.shared_spans import chunks
from corpuswright.llm.wordseq import WORD
from corpuswright.operators.analysis import lcs_length

GAP = 2  # words that may stand between the words of a pair


class Matcher:
    """Compiled items. ``rows``: (item_id, text)."""

    def __init__(self, rows: list[tuple[int, str | None]], run: int = 12, share: float = 0.75, spread: float = 1.5):
        self.run, self.share, self.spread = run, share, spread
        self.items: list[tuple[int, np.ndarray]] = []
        vocab: dict[str, int] = {}
        for item, text in sorted(rows, key=lambda r: r[0]):
            ids = [vocab.setdefault(w, len(vocab) + 1) for w in WORD.findall(text.lower())] if text else []
            if ids:
                self.items.append((int(item), np.array(ids, dtype=np.int64)))
        self.vocab, self.size = vocab, len(vocab) + 1
        self._compile_runs()
        self._compile_pairs()

    def _compile_runs(self) -> None:
        """Shift table over two-word blocks and suffix buckets for every run-word window."""
        m = self.run
        self.longest = m - 1
        where: dict[int, int] = {}
        pool, owner, ends = [], [], defaultdict(list)
        for k, (_, ids) in enumerate(self.items):
            for i in range(len(ids) - m + 1):
                p = ids[i : i + m]
                blocks = p[:-1] * self.size + p[1:]
                for j, b in enumerate(blocks.tolist()):
                    where[b] = min(where.get(b, self.longest), m - 2 - j)
                ends[int(blocks[-1])].append(len(pool))
                pool.append(p)
                owner.append(k)
        self.blocks = np.array(sorted(where), dtype=np.int64)
        self.shift = np.array([where[b] for b in self.blocks.tolist()], dtype=np.int64)
        self.pool = np.array(pool, dtype=np.int64).reshape(len(pool), m)
        self.owner = np.array(owner, dtype=np.int64)
        self.bucket = {b: np.array(v, dtype=np.int64) for b, v in ends.items()}

    def _compile_pairs(self) -> None:
        """Postings of every neighbouring pair of words, how many must be found, and the words of short items."""
        self.lengths = np.array([len(i) for _, i in self.items], dtype=np.int64)
        self.needs = np.array([math.ceil(self.share * len(i) - 1e-9) for _, i in self.items], dtype=np.int64)
        self.stretch = np.array([int(self.spread * len(i) + 1e-9) for _, i in self.items], dtype=np.int64)
        self.pairs = 2 * self.needs - self.lengths - 1 - np.maximum(self.stretch - self.needs, 0) // (GAP + 1) if len(self.items) else self.needs
        self.counts = [Counter(i.tolist()) for _, i in self.items]
        keys, owners = [], []
        self.by_word: dict[int, list[int]] = defaultdict(list)
        for k, (_, ids) in enumerate(self.items):
            if self.pairs[k] >= 1:
                p = np.unique(ids[:-1] * self.size + ids[1:])
                keys.append(p)
                owners.append(np.full(len(p), k, dtype=np.int64))
            else:
                # all but L - n occurrences must be there, so one of any L - n + 1 is: those of the last words in the vocabulary
                for w in sorted(ids.tolist(), reverse=True)[: int(self.lengths[k] - self.needs[k] + 1)]:
                    if k not in self.by_word[w][-1:]:
                        self.by_word[w].append(k)
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.posting = owner[order]
        self.pair_keys, self.first = np.unique(key[order], return_index=True)
        self.last = np.r_[self.first[1:], len(key)]

    def runs(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) pairs that share a run-word window; one jump of every text a round."""
        found: list[tuple[int, int]] = []
        if not len(self.pool) or not len(starts):
            return found
        m, piece = self.run, 256
        # long texts are cut into overlapping pieces, so that a round advances all of the batch
        text, at, stop = [], [], []
        for t, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            for p in range(s, e - m + 1, piece):
                text.append(t)
                at.append(p + m - 1)
                stop.append(min(p + piece + m - 1, e))
        text, at, stop = (np.array(x, dtype=np.int64) for x in (text, at, stop))
        while len(at):
            block = flat[at - 1] * self.size + flat[at]
            slot = np.searchsorted(self.blocks, block)
            slot[slot == len(self.blocks)] = 0
            step = np.where(self.blocks[slot] == block, self.shift[slot], self.longest)
            for i in np.flatnonzero(step == 0):
                p = self.bucket.get(int(block[i]))
                if p is not None:
                    hit = (self.pool[p] == flat[at[i] - m + 1 : at[i] + 1]).all(axis=1)
                    found += [(int(text[i]), int(k)) for k in self.owner[p[hit]]]
            at = at + np.maximum(step, 1)
            keep = at < stop
            text, at, stop = text[keep], at[keep], stop[keep]
        return found

    def likely(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) pairs that hold enough of the item's pairs within its stretch; a superset of what the rule finds."""
        out: set[tuple[int, int]] = set()
        text = np.repeat(np.arange(len(starts)), ends - starts)
        if len(self.pair_keys) and len(flat) > 1:
            spots, owners = [], []
            for gap in range(1, GAP + 2):
                if len(flat) <= gap:
                    break
                a, b = flat[:-gap], flat[gap:]
                at = np.flatnonzero((a > 0) & (b > 0) & (text[:-gap] == text[gap:]))
                key = a[at] * self.size + b[at]
                slot = np.searchsorted(self.pair_keys, key)
                slot[slot == len(self.pair_keys)] = 0
                hit = self.pair_keys[slot] == key
                at, slot = at[hit], slot[hit]
                many = self.last[slot] - self.first[slot]
                spots.append(np.repeat(at, many))
                base = np.repeat(self.first[slot] - (np.cumsum(many) - many), many)
                owners.append(self.posting[base + np.arange(many.sum())])
            spot, owner = np.concatenate(spots), np.concatenate(owners)
            if len(spot):
                order = np.lexsort((spot, owner, text[spot]))
                spot, owner = spot[order], owner[order]
                far = np.arange(len(spot)) + self.pairs[owner] - 1
                inside = far < len(spot)
                i, j = np.flatnonzero(inside), far[inside]
                close = (owner[i] == owner[j]) & (text[spot[i]] == text[spot[j]]) & (spot[j] - spot[i] < self.stretch[owner[i]])
                out.update(zip(text[spot[i[close]]].tolist(), owner[i[close]].tolist()))
        if self.by_word:
            for w, t in zip(flat.tolist(), text.tolist()):
                for k in self.by_word.get(w, ()) if w else ():
                    out.add((t, k))
        return sorted(out)

    def shares(self, words: np.ndarray, k: int) -> bool:
        """Exact: a stretch of allowed length that holds the share of the item's words in order."""
        ids, need, room, most = self.items[k][1], int(self.needs[k]), int(self.stretch[k]), self.counts[k]
        spots = np.flatnonzero(np.isin(words, ids))
        if len(spots) < need:
            return False
        # stretches may start at any item word; only starts with enough item words ahead remain
        ahead = np.searchsorted(spots, spots + room, side="left") - np.arange(len(spots))
        for s in np.flatnonzero(ahead >= need).tolist():
            part = words[spots[s : s + ahead[s]]]
            if sum(min(n, most[w]) for w, n in Counter(part.tolist()).items()) < need:
                continue
            if common(ids, part, need):
                return True
        return False

    def match(self, texts: list[str]) -> list[tuple[int, int]]:
        """(position in ``texts``, item_id), sorted and distinct."""
        get = self.vocab.get
        ids = [[get(w, 0) for w in WORD.findall(t.lower())] for t in texts]
        lens = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.array([i for x in ids for i in x], dtype=np.int64)
        ends = np.cumsum(lens)
        starts = ends - lens
        out = set(self.runs(flat, starts, ends))
        now, bag = -1, {}
        for t, k in self.likely(flat, starts, ends):
            if (t, k) in out:
                continue
            if t != now:
                now, bag = t, Counter(ids[t])
            # no more of the item's words can match than the whole text holds
            if sum(min(n, bag[w]) for w, n in self.counts[k].items() if w in bag) >= self.needs[k] and self.shares(flat[starts[t] : ends[t]], k):
                out.add((t, k))
        return sorted((t, self.items[k][0]) for t, k in out)


def common(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Whether the longest common subsequence reaches ``need``."""
    return lcs_length(a.tolist(), b.tolist()) >= need


def leaks(documents: DataFrame, items: DataFrame, run: int = 12, share: float = 0.75, spread: float = 1.5, per_set: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id) for each document that holds an item, fully or partly.

    ``items`` is held-out material; it reaches the driver in sets of at most ``per_set`` words (or one item), and each
    set is one broadcast and one scan of the documents. The test items are one set.
    """
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull())
    rows, size, out = [], 0, None
    for r in items.select("item_id", "text").where("item_id is not null").toLocalIterator():
        n = len(WORD.findall(r[1])) if r[1] else 0
        if rows and size + n > per_set:
            found = _leaks_of(texts, Matcher(rows, run, share, spread))
            out = found if out is None else out.unionByName(found)
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    found = _leaks_of(texts, Matcher(rows, run, share, spread))
    out = found if out is None else out.unionByName(found)
    return out.dropDuplicates(["doc_id", "item_id"])


def _leaks_of(texts: DataFrame, matcher: Matcher) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(matcher)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            ids, texts = b["doc_id"].to_numpy(), b["text"].tolist()
            for lo, hi in chunks(texts):
                hits = m.match(texts[lo:hi])
                yield pd.DataFrame({"doc_id": ids[[lo + t for t, _ in hits]], "item_id": np.array([k for _, k in hits], dtype=np.int64)})

    return texts.mapInPandas(scan, "doc_id long, item_id long")
