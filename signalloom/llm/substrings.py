"""Exact repeated passages: windows repeated at one length alone are extended to about twice that length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, Words, keep, mix, n_tasks, pieces

WIDTH = 13
#: Stands for a null doc_id, which is behind all others.
LAST = np.iinfo(np.int64).max
LOW = np.uint64(0xFFFFFFFF)


class Piece:
    """Some whole documents, packed in one row: the unit that is sent around and worked on."""

    def __init__(self, ids: bytes, known: bytes, sizes: bytes, blob: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.known = np.frombuffer(known, np.uint8).astype(bool)
        n = np.frombuffer(sizes, "<u4")
        raw = zstandard.ZstdDecompressor().decompress(blob)
        ends = np.cumsum(n, dtype=np.int64)
        self.texts = [raw[e - k:e] for e, k in zip(ends, n)]
        self.words = Words(self.texts)


def pack(docs: DataFrame, piece_bytes: int) -> DataFrame:
    """Pieces of ``docs`` as a written table, so that each piece keeps its number and content when work is repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, zipper = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        for batch, texts in pieces(batches, limit=piece_bytes):
            ids = batch.column(0).to_pylist()
            texts = [t or b"" for t in texts]
            row = (
                number, np.array([LAST if i is None else i for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids], np.uint8).tobytes(),
                np.array([len(t) for t in texts], "<u4").tobytes(), zipper.compress(b"".join(texts)),
            )
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i == 0 else pa.binary()) for i, v in enumerate(row)], names=["piece", "ids", "known", "sizes", "blob"])

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "piece long, ids binary, known binary, sizes binary, blob binary")
    return keep(packed, "pieces")


def half(width: int) -> int:
    """Length of the shorter windows: two of them, overlapping at most, make up one of ``width``."""
    return max(1, -(-width // 2))


class Short:
    """A piece's short windows.  A long window is stood for by the smallest hash among the short windows in it, a
    choice that its own words make: equal long windows choose alike, and neighbours mostly share their choice."""

    def __init__(self, p: Piece, width: int, buckets: int):
        w, k = p.words, half(width)
        self.at = w.windows(width)[0]
        if len(self.at):
            g = w.combined(k)
            m = g[self.at]
            for j in range(1, width - k + 1):
                m = np.minimum(m, g[self.at + j])
            chosen, self.group = np.unique(mix(m), return_inverse=True)
            doc = w.doc[self.at]
            first, last = np.full(len(chosen), w.n), np.full(len(chosen), -1)
            np.minimum.at(first, self.group, doc)
            np.maximum.at(last, self.group, doc)
            bucket = ((chosen >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            self.order = np.argsort(bucket, kind="stable")
            self.bucket = bucket[self.order]
            self.value = (chosen & LOW).astype("<u4")[self.order]
            self.own = (last > first)[self.order]
        else:
            self.order = self.bucket = np.zeros(0, np.int64)
            self.value, self.own = np.zeros(0, "<u4"), np.zeros(0, bool)

    def survivors(self, masks: dict[int, bytes]) -> np.ndarray:
        """Starts of the long windows whose chosen short window is repeated."""
        if not len(self.at):
            return self.at
        flags = np.empty(len(self.order), bool)
        flags[self.order] = unmasked(self.bucket, masks)
        return self.at[flags[self.group]]


class Long:
    """The long windows of a piece that survive, with 128-bit hashes and the smallest doc_id of each in this piece."""

    def __init__(self, p: Piece, width: int, at: np.ndarray, buckets: int):
        self.at, w = at, p.words
        if not len(at):
            self.bucket, self.group = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        a, b = (w.combined(width, seed)[at] for seed in (3, 5))
        order = np.lexsort((b, a, (a >> np.uint64(32)) % np.uint64(buckets)))
        a, b = a[order], b[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        self.group = np.empty(len(at), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.low, self.high = (a[new] & LOW).astype("<u4"), b[new].astype("<u8")
        self.bucket = ((a[new] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        self.doc = p.ids[w.doc[at]]
        self.first = np.full(len(self.low), LAST)
        np.minimum.at(self.first, self.group, self.doc)

    def removed(self, masks: dict[int, bytes]) -> np.ndarray:
        """Starts of the windows that a document with a smaller doc_id has too."""
        if not len(self.at):
            return self.at
        return self.at[unmasked(self.bucket, masks)[self.group] | (self.doc > self.first[self.group])]


def unmasked(bucket: np.ndarray, masks: dict[int, bytes]) -> np.ndarray:
    """One flag per value, from a mask per bucket; buckets are in order, those without mask have no flag."""
    flags = np.zeros(len(bucket), bool)
    for b, start, end in slices(bucket):
        if b in masks:
            flags[start:end] = np.unpackbits(np.frombuffer(masks[b], np.uint8), count=end - start).astype(bool)
    return flags


def slices(bucket: np.ndarray):
    if len(bucket):
        cut = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
        for start, end in zip(cut, cut[1:]):
            yield int(bucket[start]), int(start), int(end)


def _masks(column) -> dict[int, bytes]:
    return {x["bucket"]: x["mask"] for x in column or ()}


SLICE = "piece long, bucket int, n int, data binary"


def _emit(rows: list) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["piece", "bucket", "n", "data"])


def _pieces(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for r in batch.to_pylist():
            yield r, Piece(r["ids"], r["known"], r["sizes"], r["blob"])


def _find_short(g: pd.DataFrame) -> pd.DataFrame:
    """Short windows of one bucket that two documents have, as a mask per piece."""
    values = np.concatenate([np.frombuffer(d, "<u4", n) for d, n in zip(g["data"], g["n"])])
    own = np.concatenate([np.unpackbits(np.frombuffer(d, np.uint8, offset=4 * n), count=n) for d, n in zip(g["data"], g["n"])]).astype(bool)
    order = np.argsort(values, kind="stable")
    s = values[order]
    same = s[1:] == s[:-1]
    own[order] |= np.concatenate((same, [False])) | np.concatenate(([False], same))
    return _answers(g, own)


def _find_long(g: pd.DataFrame) -> pd.DataFrame:
    """Long windows of one bucket of which another piece has a smaller doc_id, as a mask per piece."""
    part = lambda kind, skip: np.concatenate([np.frombuffer(d, kind, n, skip * n) for d, n in zip(g["data"], g["n"])])
    high, low, first = part("<u8", 0), part("<u4", 8), part("<i8", 12)
    order = np.lexsort((first, low, high))
    h, w, f = high[order], low[order], first[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
    flags = np.empty(len(f), bool)
    flags[order] = f > f[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return _answers(g, flags)


def _answers(g: pd.DataFrame, flags: np.ndarray) -> pd.DataFrame:
    ends, out = np.cumsum(g["n"].to_numpy()), []
    for piece, bucket, n, end in zip(g["piece"], g["bucket"], g["n"], ends):
        own = flags[end - n:end]
        if own.any():
            out.append((piece, bucket, np.packbits(own).tobytes()))
    return pd.DataFrame(out, columns=["piece", "bucket", "mask"])


def _answered(slices_df: DataFrame, find, name: str) -> DataFrame:
    found = slices_df.groupBy("bucket").applyInPandas(find, "piece long, bucket int, mask binary")
    return found.groupBy("piece").agg(F.collect_list(F.struct("bucket", "mask")).alias(name))


def repeated_passages(docs: DataFrame, width: int = WIDTH, buckets: int | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, removed (spans [first, end) of words), kept_text.

    Removed is each word that a window of ``width`` words covers whose word sequence also starts in a document with a smaller doc_id;
    kept words are joined by one space.  Two levels answer that: short windows of half the length that two documents have, and
    then only the long windows around those, with 128-bit hashes.  What one length tells apart is never looked at in the next.

    Documents are packed in pieces of about ``piece_bytes``; per piece only distinct values go to ``buckets`` tasks (the
    cluster's shuffle partitions by default), and a bit per value comes back.  So a passage that a third of all documents have costs one
    value per piece, and no task gets its documents.  Raise both parameters with the input, so that a bucket fits a task.

    A null text has no words.  A null doc_id is behind all others; rows with one doc_id never remove each other's words; equal
    rows get equal results.  An empty table gives an empty result; other columns are left out.
    """
    nb = buckets or n_tasks(docs.sparkSession)
    packed = pack(docs, piece_bytes)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, p in _pieces(batches):
            s = Short(p, width, nb)
            rows = [(r["piece"], b, e - a, s.value[a:e].tobytes() + np.packbits(s.own[a:e]).tobytes()) for b, a, e in slices(s.bucket)]
            if rows:
                yield _emit(rows)

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, p in _pieces(batches):
            at = Short(p, width, nb).survivors(_masks(r["short"]))
            w = Long(p, width, at, nb)
            rows = [(r["piece"], b, e - a, w.high[a:e].tobytes() + w.low[a:e].tobytes() + w.first[a:e].astype("<i8").tobytes()) for b, a, e in slices(w.bucket)]
            if rows:
                yield _emit(rows)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, p in _pieces(batches):
            at = np.zeros(0, np.int64)
            if r["short"]:
                at = Short(p, width, nb).survivors(_masks(r["short"]))
                at = Long(p, width, at, nb).removed(_masks(r["long"]))
            n = len(p.words.doc) + width
            cover = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + width, minlength=n + 1))[:len(p.words.doc)] > 0
            yield _result(p, cover)

    first = _answered(packed.select("piece", "ids", "known", "sizes", "blob").mapInArrow(short, SLICE), _find_short, "short")
    first = keep(first, "short-windows")
    second = packed.join(first, "piece").mapInArrow(long, SLICE)
    second = keep(_answered(second, _find_long, "long"), "long-windows")
    answers = first.join(second, "piece", "left")
    return packed.join(answers, "piece", "left").mapInArrow(result, "doc_id long, n_words long, removed array<struct<first:int,end:int>>, kept_text string")


def _result(p: Piece, cover: np.ndarray) -> pa.RecordBatch:
    counts = p.words.counts()
    ends, kept, spans = np.cumsum(counts), [], []
    for text, n, end in zip(p.texts, counts, ends):
        own = cover[end - n:end]
        words = text.split()
        if own.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
            spans.append([{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            words = [w for w, gone in zip(words, own.tolist()) if not gone]
        else:
            spans.append([])
        kept.append(b" ".join(words).decode())
    ids = [int(i) if k else None for i, k in zip(p.ids, p.known)]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
        names=["doc_id", "n_words", "removed", "kept_text"],
    )
