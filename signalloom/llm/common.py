"""Helpers shared by the corpus operators: words as arrays, hashes, kept tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one round of array work handles; a longer text is a round of its own.
PIECE_BYTES = 1 << 21


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  A folder of our own only in local mode, where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read again: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_tasks(spark: SparkSession) -> int:
    """Tasks of an explicit shuffle: what the cluster set for all shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hex_number(text: Column, digits: int, start: int = 1) -> Column:
    """The number that some of the hexadecimal digits of md5(text) spell."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("long")


def text_key(c: Column) -> Column:
    """A string that tells null from every text."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c.cast("string")))


# ---- arrays -------------------------------------------------------------------------------------

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    start = seed * 0xD1B54A32D192ED03 % (1 << 64)
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(start))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = randoms(256, 1)
_BASES = [int(x) | 1 for x in randoms(2, 2)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64, kept for the next call."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        both = []
        for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(n, b, dtype=U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[which] = both[0], both[1]
    return _POWERS[which][0][:n], _POWERS[which][1][:n]


def span_hash(b: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of stretches of bytes; equal stretches have equal hashes wherever they are.  Two kinds, by ``which``."""
    power, inverse = _powers(max(1, len(b)), which)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[b] * power[:len(b)], dtype=U)))
    return mix((sums[end] - sums[start]) * inverse[np.minimum(start, len(b) - 1)] + (end - start).astype(U))


class Words:
    """All words of some texts: ``doc`` (row of its text), ``hash``, ``start`` and ``end`` in ``bytes``."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        b = np.frombuffer(joined, dtype=np.uint8)
        if lower:
            b = _LOWER[b]
        self.bytes = b
        space = _SPACE[b]
        before = np.concatenate(([True], space[:-1]))
        self.start = np.flatnonzero(before & ~space)
        self.end = np.flatnonzero(space & ~before)
        self.text_end = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.doc = np.searchsorted(self.text_end, self.start, side="right")
        self.n = len(texts)
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(self.bytes, self.start, self.end)
        return self._hash

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n)

    def windows(self, width: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Start words of the windows that lie in one text, and the windows' hashes."""
        n = len(self.doc) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1:])
        return at, self.combined(width, seed)[at]

    def combined(self, width: int, seed: int = 3) -> np.ndarray:
        """Hash of the ``width`` words from each word on, whatever texts they are in."""
        n = len(self.doc) - width + 1
        base = randoms(1, seed)[0] | U(1)
        h = np.zeros(n, U)
        for j in range(width):
            h = h * base + self.hash[j:j + n]
        return mix(h)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES):
    """Runs of rows of about ``limit`` bytes of text: (batch of these rows, texts as bytes, null as None)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            n = len(t or b"") + 1
            if i > start and size + n > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += n
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def kept_columns(df: DataFrame, names) -> list[str]:
    """Columns that do not clash with ``names`` (compared as Spark does, without case)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]
