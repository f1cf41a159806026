"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, pieces, randoms

PAD = np.uint64(0)
#: Coordinates of the embedding that make a key, and its length against the window's.
SAMPLED, STRETCH = 2, 3
#: Most repetitions; reached only where edits are a large part of an item.
MOST_REPEATS = 64


def plain(texts: list[bytes | None]) -> Words:
    """Words in lower case, without ASCII punctuation: what a passage keeps when it is copied by hand."""
    return Words([(t or b"").decode(errors="replace").lower().encode().translate(_PLAIN) for t in texts])


_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() or c == 10 else 32 for c in range(256))


def allowed(n_words: np.ndarray | int, rate: float):
    return np.floor(np.asarray(n_words) * rate + 1e-9).astype(np.int64)


@dataclass
class Walk:
    """One repetition for windows of one width: a random walk and the coordinates that are looked at."""

    seed: int
    coordinates: np.ndarray

    def keys(self, w: np.ndarray) -> np.ndarray:
        """Key of each window (rows of word hashes).  At step j the walk reads a word and goes on to the next one or stays, as a
        random bit of (word, j) says; equal words at equal steps move alike, so an edit upsets few coordinates."""
        n, width = w.shape
        rows, at, key = np.arange(n), np.zeros(n, np.int64), np.full(n, np.uint64(self.seed))
        wide = np.concatenate((w, np.full((n, 1), PAD)), 1)
        looked = set(self.coordinates.tolist())
        steps = randoms(STRETCH * width, self.seed)
        for j in range(max(looked) + 1):
            word = wide[rows, at]
            if j in looked:
                key = mix(key ^ (word + np.uint64(j)))
            at = np.minimum(at + (mix(word ^ steps[j]) & np.uint64(1)).astype(np.int64), width)
        return key


def walks(width: int, repeats: int) -> list[Walk]:
    g = np.random.default_rng(width)
    return [Walk(1000 * width + r, np.sort(g.choice(STRETCH * width, min(SAMPLED, STRETCH * width), replace=False))) for r in range(repeats)]


def hit_rate(width: int, edits: int, trials: int = 300) -> float:
    """Measured chance that a window and one with ``edits`` random edits, moved by a word, share one repetition's key."""
    g = np.random.default_rng(edits * 1000 + width)
    a = g.integers(1, 1 << 62, (trials, width)).astype(np.uint64)
    b = np.empty_like(a)
    for i in range(trials):
        v = a[i].tolist()
        for _ in range(edits):
            p, kind = int(g.integers(0, len(v))), int(g.integers(0, 3))
            v[p:p + (kind != 1)] = [] if kind == 2 and len(v) > 1 else [int(g.integers(1, 1 << 62))]
        v += g.integers(1, 1 << 62, width).tolist()
        b[i] = np.array(v[:width], np.uint64)
    some = walks(width, 8)
    return max(float(np.mean([np.mean(w.keys(a) == w.keys(b)) for w in some])), 1e-3)


class Items:
    """Search structure over a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[bytes], rate: float, recall: float, min_words: int):
        w = plain(texts)
        ends = np.cumsum(w.counts())
        self.items = [(i, w.hash[e - n:e]) for i, n, e in zip(ids, w.counts(), ends) if n >= min_words]
        self.rate = rate
        sizes = np.array([len(x) for _, x in self.items], np.int64)
        k = allowed(sizes, rate)
        # k edits cut a window of n words into k + 1 stretches at most, so one stretch of this many words is untouched.
        self.gram = int(max(1, min(6, ((sizes - k) // (k + 1)).min()))) if len(sizes) else 1
        grams, offset, width = [], [], []
        for _, x in self.items:
            for o in range(len(x) - self.gram + 1):
                grams.append(gram_hash(x[o:o + self.gram], self.gram)[0])
                offset.append(o)
                width.append(len(x))
        order = np.argsort(np.array(grams, np.uint64), kind="stable")
        self.grams, self.first, self.many = np.unique(np.array(grams, np.uint64)[order], return_index=True, return_counts=True)
        self.offset, self.width = np.array(offset, np.int64)[order], np.array(width, np.int64)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.grams & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.tables = {}
        for n in sorted(set(sizes.tolist())):
            own = np.flatnonzero(sizes == n)
            edits = int(allowed(n, rate))
            p = hit_rate(n, edits) if edits else 1.0
            repeats = 1 if p >= 1 else min(MOST_REPEATS, max(1, ceil(log(1 - recall) / log(1 - p))))
            matrix = np.stack([self.items[i][1] for i in own])
            tables = []
            for walk in walks(n, repeats):
                keys = walk.keys(matrix)
                order = np.argsort(keys, kind="stable")
                tables.append((walk, keys[order], own[order]))
            self.tables[n] = tables

    def windows(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Starts and widths of the windows that lie around a stretch of words which an item has too."""
        n = len(w.doc) - self.gram + 1
        if n <= 0 or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = gram_hash(w.hash, self.gram)
        at = np.flatnonzero(self.maybe[(g & np.uint64(0xFFFFF)).astype(np.int64)])
        at = at[w.doc[at] == w.doc[at + self.gram - 1]]
        found = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        hit = self.grams[found] == g[at]
        at, found = at[hit], found[hit]
        many = self.many[found]
        which = np.repeat(self.first[found], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        both = np.unique(np.stack((np.repeat(at, many) - self.offset[which], self.width[which], w.doc[np.repeat(at, many)]), 1), axis=0)
        # Windows that stick out of their text are moved into it, as far as they fit.
        low = np.searchsorted(w.doc, both[:, 2], "left")
        high = np.searchsorted(w.doc, both[:, 2], "right")
        start = np.maximum(low, np.minimum(both[:, 0], high - both[:, 1]))
        u = np.unique(np.stack((start, both[:, 1]), 1), axis=0)
        return u[:, 0], u[:, 1]

    def matches(self, w: Words) -> list[tuple[int, int, int, int]]:
        """(text, item number, edits, start word in the text) of every item found, its best place first."""
        starts, widths = self.windows(w)
        if not len(starts):
            return []
        lows = np.searchsorted(w.doc, np.arange(w.n), "left")
        highs = np.searchsorted(w.doc, np.arange(w.n), "right")
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n in np.unique(widths).tolist():
            at = starts[widths == n]
            doc = w.doc[np.minimum(at, len(w.doc) - 1)]
            window = gather(w.hash, at, n, lows[doc], highs[doc])
            pairs = []
            for walk, keys, items in self.tables[n]:
                k = walk.keys(window)
                lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
                many = hi - lo
                rows = np.repeat(np.arange(len(k)), many)
                which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                pairs.append(np.stack((rows, items[which]), 1))
            pairs = np.unique(np.concatenate(pairs), axis=0)
            k = int(allowed(n, self.rate))
            for i in range(0, len(pairs), 4096):
                part = pairs[i:i + 4096]
                rows, item = part[:, 0], part[:, 1]
                text = gather(w.hash, at[rows] - k - 1, n + 2 * k + 2, lows[doc[rows]], highs[doc[rows]])
                edits = edit_distance(np.stack([self.items[j][1] for j in item]), text)
                for r, j, e in zip(rows[edits <= k], item[edits <= k], edits[edits <= k]):
                    key, value = (int(doc[r]), int(j)), (int(e), int(at[r] - lows[doc[r]]))
                    best[key] = min(best.get(key, value), value)
        return [(*key, *value) for key, value in sorted(best.items())]


def gram_hash(h: np.ndarray, width: int) -> np.ndarray:
    n, out = len(h) - width + 1, np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    return mix(out)


def gather(h: np.ndarray, start: np.ndarray, width: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows of ``width`` words from ``start`` on; places outside [low, high) are padding."""
    at = start[:, None] + np.arange(width)
    out = h[np.clip(at, 0, len(h) - 1)]
    out[(at < low[:, None]) | (at >= high[:, None])] = PAD
    return out


def edit_distance(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Smallest number of word edits between each item and any stretch of its text row."""
    steps = np.arange(text.shape[1] + 1)
    d = np.zeros((len(item), text.shape[1] + 1), np.int32)
    for i in range(item.shape[1]):
        e = d + 1
        e[:, 1:] = np.minimum(e[:, 1:], d[:, :-1] + (text != item[:, i:i + 1]))
        d = np.minimum.accumulate(e - steps, axis=1) + steps
    return d.min(1)


def contaminated(
    docs: DataFrame, items: DataFrame, edit_rate: float = 0.15, recall: float = 0.999, min_words: int = 8, block_bytes: int = 8 << 20,
) -> DataFrame:
    """(doc_id, item_id, edits, start, item_words) of every benchmark item that a document has a near copy of.

    A near copy is a stretch of the document within ``edit_rate`` word edits per word of the item, in lower case and without ASCII
    punctuation.  Windows of each item's size around a stretch of words that some item has too (by pigeonhole every near copy has
    one) are embedded by CGK random walks; windows and items that agree at sampled coordinates in any repetition are compared exactly.
    Repetitions are as many as the measured agreement at the largest number of edits asks for ``recall``.

    The items are the stated query set: blocks of about ``block_bytes`` of text go to all tasks one after another, so a
    larger benchmark means more passes, never a larger broadcast.  Documents are read where they lie; nothing is shuffled.

    Null or empty texts match nothing; items of fewer than ``min_words`` words are too short to tell a copy and match nothing.  Equal
    rows give equal rows, equal items are found each.  Empty tables give an empty result; other columns are left out.
    """
    q = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = q.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    schema = "doc_id long, item_id long, edits int, start int, item_words int"
    out = None
    for b in range(blocks):
        own = sorted((r.text, r.item_id is None, r.item_id) for r in q.filter(block == b).collect())
        index = Items([i for _, _, i in own], [t.encode() for t, _, _ in own], edit_rate, recall, min_words)
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_finder(index), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(index: Items):
    names = ["doc_id", "item_id", "edits", "start", "item_words"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            rows = index.matches(plain(texts))
            if rows:
                ids = batch.column(0).to_pylist()
                flat = [(ids[t], index.items[j][0], e, s, len(index.items[j][1])) for t, j, e, s in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], k) for i, k in enumerate(types)], names=names)

    return run


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows with a null doc_id are judged by their own text."""
    from .common import kept_columns

    q = items.select("item_id", "text")
    marked = docs.select(F.struct("*").alias("_row"), "doc_id", "text").withColumn("_key", F.xxhash64(F.col("doc_id"), F.col("text")))
    bad = contaminated(marked.select(F.col("_key").alias("doc_id"), "text"), q, **options).select(F.col("doc_id").alias("_key")).distinct()
    return marked.join(bad, "_key", "left_anti").select(*[F.col("_row")[c].alias(c) for c in kept_columns(docs, ())])
