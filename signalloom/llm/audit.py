"""What filters do to each other: truth-table words of surviving subsets and their positional counts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

FILTERS = "ABCDE"
#: The filter that looks at other documents: its bit in the set of failures.
COPY = 1 << FILTERS.index("E")
N_SETS = 1 << len(FILTERS)
ALL_BITS = (1 << N_SETS) - 1
_UPPER = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))
_SIGNS = b"#$%&*|"
_GAP = re.compile(rb"[\x20\x09-\x0D]").search
#: Bytes of a text whose words are listed at once.
STRETCH = 1 << 20


def word(failed: int) -> int:
    """The 32-bit word of a document: bit S is set if it survives the filters in S, that is, if it fails none of them."""
    return sum(1 << s for s in range(N_SETS) if not s & failed)


WORDS = np.array([word(f) for f in range(N_SETS)], np.uint32)
#: Bits of the subsets that contain the copy filter.
WITH_COPY = sum(1 << s for s in range(N_SETS) if s & COPY)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many words have each bit set, by carry-save adders: three words of one weight become a sum and a carry of twice the weight."""
    total, level = np.zeros(N_SETS, np.int64), words.astype(np.uint32)
    weight = 1
    while len(level):
        carries = []
        while len(level) > 2:
            n = len(level) // 3
            a, b, c = level[:n], level[n:2 * n], level[2 * n:3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate((half ^ c, level[3 * n:]))
        for w in level:
            total += weight * (w >> np.arange(N_SETS, dtype=np.uint32) & 1).astype(np.int64)
        level, weight = np.concatenate(carries) if carries else level[:0], 2 * weight
    return total


def weighted_counts(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Positional counts of words that occur several times: one count per bit of the times."""
    bits = range(int(times.max()).bit_length())
    return sum((positional_counts(words[times >> k & 1 == 1]) << k for k in bits), np.zeros(N_SETS, np.int64))


def failures(text: bytes) -> int:
    """The failed filters A to D of a whole text, as a set of bits."""
    n, distinct, at = 0, set(), 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            # A stretch ends at white space, so that no word is cut; a longer word lengthens it.
            gap = _GAP(text, end)
            end = gap.start() if gap else len(text)
        # bytes.split() parts at ASCII white space alone.
        words = text[at:end].split()
        n += len(words)
        distinct.update(words)
        at = end
    upper, chars = len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _INNER))
    signs = len(text.translate(None, _SIGNS)) < len(text)
    return (n < 200) | (100 * len(distinct) < 50 * n) << 1 | (100 * upper > 3 * chars) << 2 | signs << 3


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest of the text, failed filters A to D) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, failed = [], []
            for value in batch.column(2):
                text = value.as_buffer().to_pybytes() if value.is_valid else b""
                digests.append(hashlib.md5(text).digest())
                failed.append(failures(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(failed, pa.int32())], names=["doc_id", "part", "digest", "failed"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, failed int")


def _counted(rows: DataFrame, mask: int) -> DataFrame:
    """Per part and label the positional counts of the rows' words (only the bits of ``mask``), one partial row per batch, part and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).dictionary_encode()
            label, failed, times = (np.asarray(batch.column(i)) for i in (1, 2, 3))
            code = np.asarray(part.indices).astype(np.int64) * 4 + label
            order = np.argsort(code, kind="stable")
            values, first = np.unique(code[order], return_index=True)
            words, times = (WORDS & np.uint32(mask))[failed][order], times[order]
            counts = [weighted_counts(w, n) for w, n in zip(np.split(words, first[1:]), np.split(times, first[1:]))]
            yield pa.RecordBatch.from_arrays(
                [part.dictionary.take(pa.array(values // 4)), pa.array(values % 4, pa.int32()), pa.array(counts, pa.list_(pa.int64()))], names=["part", "label", "counts"]
            )

    return rows.select("part", "label", "failed", "n").mapInArrow(run, "part string, label int, counts array<long>")


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, label, survivors): for each subset of the filters (array place = set bits, A lowest) how many documents survive it.

    ``label`` is 1 for quality, plus 2 for toxic.  The word of a document is counted in two halves: the subsets without the copy
    filter where the document is read, those with it only for documents that pass that filter, which are the first of each text.  So
    no verdict goes back to the copies, and a text that a third of all rows share is one partial minimum per task.
    """
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int")
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((flag("quality") + 2 * flag("toxic")).alias("label"))
    rows = judged(docs)
    # Rows without an id have no label and no smaller or greater id: they do not meet the labels.
    named = rows.filter("doc_id IS NOT NULL").join(known, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    rows = keep(named.select(*rows.columns, "label").union(rows.filter("doc_id IS NULL").withColumn("label", F.lit(0))), "audit")

    same = rows.filter("doc_id IS NOT NULL").groupBy("digest", "doc_id", "part", "label", "failed").agg(F.count(F.lit(1)).alias("n"))
    ties = same.groupBy("digest", "doc_id").agg(F.collect_list(F.struct("part", "label", "failed", "n")).alias("rows"))
    first = ties.groupBy("digest").agg(F.min_by("rows", "doc_id").alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    rows = rows.select("doc_id", "part", "label", "failed", F.lit(1).cast("long").alias("n"))
    first = first.union(rows.filter("doc_id IS NULL").select(*first.columns))
    everything = _counted(rows, ALL_BITS ^ WITH_COPY).union(_counted(first, WITH_COPY))
    places = [F.sum(F.element_at("counts", s + 1)).alias(f"s{s}") for s in range(N_SETS)]
    return everything.groupBy("part", "label").agg(*places).select("part", "label", F.array(*[F.col(f"s{s}") for s in range(N_SETS)]).alias("survivors"))


def _orders() -> dict[str, np.ndarray]:
    """All orders and their steps: the set applied before, the filter, and the set behind."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    bits = np.array([[1 << FILTERS.index(c) for c in o] for o in orders])
    after = np.cumsum(bits, axis=1)
    steps = np.tile(np.arange(1, len(FILTERS) + 1), len(orders))
    return {"order": np.repeat(orders, len(FILTERS)), "step": steps, "bit": bits.ravel(), "before": (after - bits).ravel(), "after": after.ravel()}


def _shapley(n: np.ndarray) -> np.ndarray:
    """Per filter what it removes, summed over all orders: each set before it occurs in (its orders) times (orders of the others)."""
    out, k = np.zeros(len(FILTERS), np.int64), len(FILTERS)
    for f in range(k):
        for s in range(N_SETS):
            if not s >> f & 1:
                size = s.bit_count()
                out[f] += factorial(size) * factorial(k - 1 - size) * (n[s] - n[s | 1 << f])
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what the step's filter keeps, removes, and would have removed elsewhere.

    Filters fail documents that: A have under 200 words; B have fewer than half as many distinct words as words; C have over 3 %
    capitals; D hold one of ``#$%&*|``; E have the text of a smaller doc_id.  All figures are differences of survivor counts, so
    only 32 numbers per part and label leave the counting.

    A null text is empty, a null lang the part ``''``.  A row with a null doc_id is nobody's copy, has no copies and no label.
    Repeated rows count each; rows with one doc_id and one text are no copies of each other.  Of several labels of a doc_id, any 1
    counts.  Other columns are not read; labels without a document count nothing; an empty table gives no row.
    """
    table = survivors(docs, labels)
    add = lambda when: [F.sum(F.when(when, F.element_at("survivors", s + 1)).otherwise(0)) for s in range(N_SETS)]
    label: Column = F.col("label")
    sums = {"n": F.lit(True), "good": label.bitwiseAND(1) == 1, "toxic": label.bitwiseAND(2) == 2}
    per_part = table.groupBy("part").agg(*[F.array(*add(when)).alias(k) for k, when in sums.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = _orders()
        f = np.log2(o["bit"]).astype(int)
        full = N_SETS - 1
        for batch in batches:
            for part, *lists in zip(*(batch.column(i).to_pylist() for i in range(4))):
                n, good, toxic = (np.array(x, np.int64) for x in lists)
                removed = n[o["before"]] - n[o["after"]]
                columns = {
                    "kept": n[o["after"]], "removed": removed, "redundant": n[0] - n[o["bit"]] - removed, "unique_fails": n[full ^ o["bit"]] - n[full],
                    "good_lost": good[o["before"]] - good[o["after"]], "toxic_lost": toxic[o["before"]] - toxic[o["after"]], "shapley": _shapley(n)[f],
                }
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(removed)), pa.array(o["order"]), pa.array(o["step"], pa.int32()), *(pa.array(v, pa.int64()) for v in columns.values())],
                    names=["part", "filter_order", "step", *columns],
                )

    return per_part.mapInArrow(
        run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    )
