"""Language identification by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PIECE_BYTES, kept_columns, pieces

#: Bytes of a window; a text is cut into windows, the last one ends where the text ends.
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8


@dataclass
class Net:
    """Byte embedding, filters of several widths, maximum over places, softmax."""

    labels: list[str]
    embed: np.ndarray  # 256 x DIM
    filters: list[np.ndarray]  # width * DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray  # len(WIDTHS) * FILTERS x labels
    out_bias: np.ndarray

    @staticmethod
    def new(labels: list[str], seed: int = 0) -> Net:
        g = np.random.default_rng(seed)
        f = lambda *s, scale: (g.standard_normal(s) * scale).astype(np.float32)
        return Net(
            labels, f(256, DIM, scale=0.5), [f(w * DIM, FILTERS, scale=(w * DIM) ** -0.5) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS], f(len(WIDTHS) * FILTERS, len(labels), scale=0.1), np.zeros(len(labels), np.float32),
        )

    def pooled(self, x: np.ndarray, places: bool = False):
        """Largest answer of each filter in each window (rows of ``x``: bytes), relu; and where it was."""
        e = self.embed[x].reshape(len(x), -1)
        tops, where = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            n = x.shape[1] - w + 1
            view = np.lib.stride_tricks.as_strided(e, (len(x), n, w * DIM), (e.strides[0], DIM * e.strides[1], e.strides[1]))
            answer = np.ascontiguousarray(view).reshape(-1, w * DIM) @ f
            answer = answer.reshape(len(x), n, FILTERS)
            if places:
                where.append(answer.argmax(1))
            tops.append(np.maximum(answer.max(1) + b, 0))
        return np.concatenate(tops, 1), where

    def probabilities(self, x: np.ndarray, step: int = 512) -> np.ndarray:
        done = [softmax(self.pooled(x[i:i + step])[0] @ self.out + self.out_bias) for i in range(0, len(x), step)]
        return np.concatenate(done) if done else np.zeros((0, len(self.labels)), np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 8, rate: float = 0.01, batch: int = 64, seed: int = 0) -> Net:
    """Adam on cross-entropy; gradients flow through the place where each filter was largest."""
    net = Net.new(labels, seed)
    params = [net.embed, *net.filters, *net.bias, net.out, net.out_bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    g = np.random.default_rng(seed)
    for _ in range(epochs):
        order = g.permutation(len(x))
        for i in range(0, len(x), batch):
            at = order[i:i + batch]
            xb, n = x[at], len(at)
            h, where = net.pooled(xb, places=True)
            d = softmax(h @ net.out + net.out_bias)
            d[np.arange(n), y[at]] -= 1
            d /= n
            dh = (d @ net.out.T) * (h > 0)
            grads_f, grads_b, ge = [], [], np.zeros_like(net.embed)
            for k, w in enumerate(WIDTHS):
                dk = dh[:, k * FILTERS:(k + 1) * FILTERS]
                near = where[k][:, :, None] + np.arange(w)  # n, FILTERS, w
                code = xb[np.arange(n)[:, None, None], near]
                patch = net.embed[code].reshape(n, FILTERS, w * DIM)
                grads_f.append(np.einsum("nf,nfd->df", dk, patch))
                grads_b.append(dk.sum(0))
                back = dk[:, :, None] * net.filters[k].T[None]  # n, FILTERS, w * DIM
                np.add.at(ge, code.reshape(-1), back.reshape(-1, DIM))
            grads = [ge, *grads_f, *grads_b, h.T @ d, d.sum(0)]
            t += 1
            for p, q, a, b in zip(params, grads, m, v):
                a += 0.1 * (q - a)
                b += 0.001 * (q * q - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return net


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows that cover the texts (zero bytes fill short texts), and the text of each."""
    starts, rows, at = [], [], 0
    for i, t in enumerate(texts):
        n = max(1, -(-len(t) // size))
        s = np.arange(n) * size
        if len(t) >= size:
            s[-1] = len(t) - size
        starts.append(at + s)
        rows.append(np.full(n, i))
        at += max(len(t), size)
    buffer = np.frombuffer(b"".join(t.ljust(size, b"\0") for t in texts), np.uint8)
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return buffer[starts[:, None] + np.arange(size)], np.concatenate(rows) if rows else starts


def has_letter(text: bytes) -> bool:
    lower = text.lower()
    return lower != text.upper() or any(c.isalpha() for c in text.decode(errors="replace"))


def sample(docs: DataFrame, per_label: int, seed: str, max_labels: int, chars: int = 1024) -> list[tuple[str, str]]:
    """At most ``per_label`` rows of each label by the smallest hash, each with a stretch of ``chars`` at a hashed place.

    A bounded sample by design: at most ``max_labels`` labels, and only labels * per_label * chars characters reach the driver.
    """
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text"))
    start = F.pmod(key, F.greatest(F.lit(1), F.length("text") - chars)) + 1
    d = docs.filter("text is not null and lang is not null").select("lang", "text", key.alias("_h"), start.alias("_at"))
    # First where each label's smallest hashes end, from hashes alone; then the texts of these rows alone.
    ranked = d.select("lang", "_h").withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).filter(F.col("_n") <= per_label)
    ends = {r[0]: r[1] for r in ranked.groupBy("lang").agg(F.max("_h")).orderBy("lang").limit(max_labels).collect()}
    if not ends:
        return []
    end = F.create_map(*[F.lit(x) for kv in ends.items() for x in kv])
    rows = d.filter(F.col("_h") <= F.try_element_at(end, F.col("lang"))).select("lang", F.col("text").substr(F.col("_at").cast("int"), F.lit(chars)).alias("text"))
    return [(r.lang, r.text) for r in rows.distinct().limit(per_label * len(ends)).collect()]


def fit(docs: DataFrame, per_label: int = 300, seed: str = "sample", max_labels: int = 200) -> Net | None:
    """Train on ``per_label`` stretches per label; null if there is nothing to learn from."""
    texts = sorted((lang, text) for lang, text in sample(docs, per_label, seed, max_labels) if has_letter(text.encode()))
    labels = sorted({lang for lang, _ in texts})
    if not labels:
        return None
    x, row = windows([t.encode() for _, t in texts])
    y = np.array([labels.index(lang) for lang, _ in texts])[row]
    return train(x, y, labels)


def predict(docs: DataFrame, net: Net | None) -> DataFrame:
    """Add lang_pred and score: mean log-probability over all windows of the whole text, then softmax.

    ``und`` with score 0 where the text is null, empty or has no letter, and everywhere if nothing was learned.  Only
    ``text`` is read; columns named like results are replaced; equal texts get equal answers; an empty table gives none.
    """
    kept = kept_columns(docs, ("lang_pred", "score"))
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, limit=PIECE_BYTES // 4):
            label, score = ["und"] * len(texts), [0.0] * len(texts)
            use = [i for i, t in enumerate(texts) if net and t and has_letter(t)]
            if use:
                x, row = windows([texts[i] for i in use])
                logs = np.log(net.probabilities(x).astype(np.float64) + 1e-9)
                total = np.stack([np.bincount(row, weights=logs[:, k]) for k in range(logs.shape[1])], 1) / np.bincount(row)[:, None]
                p = softmax(total)
                for i, best, q in zip(use, p.argmax(1), p.max(1)):
                    label[i], score[i] = net.labels[best], float(q)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(label), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return docs.select(*(kept if "text" in kept else [*kept, "text"])).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
