"""Token ids as wavelet matrices: one compressed file per shard with access, counting and lookup."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, n_tasks, new_path, pieces, span_hash

END_ID = 2
SHARD_TOKENS = 1 << 20
MAGIC = b"WVM1"
#: Bits of one rank block: counts are kept for each block, the bits between are counted on demand.
BLOCK = 1024


# ---- the file -----------------------------------------------------------------------------------


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, level: int = 3) -> bytes:
    """The file of one shard: header, documents, bit-planes (highest bit first), each compressed alone."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    known = np.array([d is not None for d in doc_ids], dtype=bool)
    plain = np.array([d or 0 for d in doc_ids], dtype="<i8")
    parts = [np.packbits(known).tobytes() + plain.tobytes() + lengths.astype("<u4").tobytes()]
    v, zeros = ids.astype(np.uint32 if width > 16 else np.uint16), []
    for bit in range(width - 1, -1, -1):
        ones = (v >> bit & 1).astype(bool)
        parts.append(np.packbits(ones, bitorder="little").tobytes())
        zero = np.flatnonzero(~ones)
        v = np.concatenate((v.take(zero), v.take(np.flatnonzero(ones))))
        zeros.append(len(zero))
    packed = [zstandard.ZstdCompressor(level=level).compress(p) for p in parts]
    sizes = [len(p) for p in packed]
    head = struct.pack("<4sBQQ", MAGIC, width, len(ids), len(doc_ids)) + struct.pack(f"<{width}Q{width + 1}Q", *zeros, *sizes)
    return head + b"".join(packed)


class Shard:
    """Reads one file; planes are decompressed when first needed."""

    def __init__(self, data: bytes):
        magic, self.width, self.n, self.n_docs = struct.unpack_from("<4sBQQ", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = struct.calcsize("<4sBQQ")
        numbers = struct.unpack_from(f"<{2 * self.width + 1}Q", data, at)
        self.zeros, sizes = numbers[:self.width], numbers[self.width:]
        self._at = np.cumsum([at + 8 * len(numbers), *sizes])
        self._data = data
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        raw, bits = self._part(0), (self.n_docs + 7) // 8
        known = np.unpackbits(np.frombuffer(raw, np.uint8, bits))[:self.n_docs].astype(bool)
        ids = np.frombuffer(raw, "<i8", self.n_docs, bits)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.lengths = np.frombuffer(raw, "<u4", self.n_docs, bits + 8 * self.n_docs).astype(np.int64)

    def _part(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._data[self._at[i]:self._at[i + 1]])

    def bits(self, level: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self._part(level + 1), np.uint8), count=self.n, bitorder="little").astype(bool)

    def _plane(self, level: int):
        if level not in self._planes:
            bits = self.bits(level)
            full = np.zeros(-(-max(1, self.n) // BLOCK) * BLOCK, bool)
            full[:self.n] = bits
            self._planes[level] = bits, np.concatenate(([0], np.cumsum(full.reshape(-1, BLOCK).sum(1))))
        return self._planes[level]

    def rank(self, level: int, i: int, bit: int = 1) -> int:
        """How many of the first ``i`` bits of a plane are ``bit``."""
        bits, blocks = self._plane(level)
        ones = int(blocks[i // BLOCK]) + int(np.count_nonzero(bits[i // BLOCK * BLOCK:i]))
        return ones if bit else i - ones

    def select(self, level: int, k: int, bit: int = 1) -> int:
        """Place of the ``k``-th (from 0) bit of a plane that is ``bit``."""
        bits, blocks = self._plane(level)
        counts = blocks if bit else np.arange(len(blocks)) * BLOCK - blocks
        b = int(np.searchsorted(counts, k, side="right")) - 1
        part = bits[b * BLOCK:(b + 1) * BLOCK]
        return b * BLOCK + int(np.flatnonzero(part == bool(bit))[k - int(counts[b])])

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        value = 0
        for level in range(self.width):
            bit = int(self._plane(level)[0][i])
            value = value << 1 | bit
            i = self.zeros[level] + self.rank(level, i) if bit else self.rank(level, i, 0)
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.width):
            bit = token >> (self.width - 1 - level) & 1
            start, end = (self.rank(level, x, bit) + (self.zeros[level] if bit else 0) for x in (start, end))
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often ``token`` is among the ids from ``start`` to ``end``."""
        if token >> self.width:
            return 0
        a, b = self._range(token, min(start, self.n), self.n if end is None else min(end, self.n))
        return max(0, b - a)

    def occurrence(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) ``token``."""
        if k < 0 or k >= self.count(token):
            raise IndexError(k)
        at = self._range(token, 0, self.n)[0] + k
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            at = self.select(level, at - (self.zeros[level] if bit else 0), bit)
        return at

    def ids(self) -> np.ndarray:
        """All ids: the planes' stable partitions undone from the lowest bit up."""
        v = np.zeros(self.n, np.uint32 if self.width > 16 else np.uint16)
        for level in range(self.width - 1, -1, -1):
            ones = self.bits(level)
            out = np.empty_like(v)
            out[np.flatnonzero(~ones)] = v[:self.zeros[level]]
            out[np.flatnonzero(ones)] = v[self.zeros[level]:] | v.dtype.type(1 << (self.width - 1 - level))
            v = out
        return v


# ---- the encoder --------------------------------------------------------------------------------


def _of(*codes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[c for x in codes for c in (x if isinstance(x, range) else [x])]] = True
    return out


#: Kinds of UTF-8 bytes.  Visible: an ASCII sign, or the first byte of a character of which none is white space.
_VISIBLE = _of(range(33, 127), range(0xC3, 0xE1), range(0xE4, 0xF5))
_LETTER = _of(range(65, 91), range(97, 123))
_STOP = _of(*b".,;:!?)")
_INNER = _of(range(0x80, 0xC0))


def stretches(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts of stretches of the texts in ``b`` that begin at ``starts``, such that no word of the pattern crosses one.

    Cut are: before a single space or line feed between visible characters, behind such a line feed, and before a stop behind a
    letter.  What is not surely so (other white space, rare scripts' marks) is not cut; a longer stretch is right too.
    """
    n = len(b)
    if not n:
        return starts[:0]
    pad = np.concatenate((np.zeros(3, np.uint8), b, np.zeros(1, np.uint8)))
    here, left, left2, left3, right = pad[3:-1], pad[2:-2], pad[1:-3], pad[:-4], pad[4:]
    inner = _INNER[left]
    two = inner & (left2 >= 0xC3) & (left2 <= 0xDF)
    three = inner & _INNER[left2] & (_VISIBLE[left3] & (left3 >= 0xE0))
    before = (_VISIBLE[left] & (left < 128)) | two | three
    cut = before & _VISIBLE[right] & ((here == 32) | (here == 10))
    cut[1:] |= cut[:-1] & (here[:-1] == 10)
    letter = _LETTER[left] | (inner & (left2 == 0xC3) & (left != 0x97) & (left != 0xB7))
    cut |= letter & _STOP[here]
    cut[starts[starts < n]] = True
    return np.flatnonzero(cut)


#: A stretch that is one word of the pattern for sure, so that the model can be asked directly.
_WORD = re.compile("(?: |)[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: The model's sign of each byte: visible Latin-1 signs stand for themselves, the others follow from 256 on.
_SIGN, _more = {}, 256
for _c in range(256):
    if not (33 <= _c <= 126 or 161 <= _c <= 172 or _c >= 174):
        _SIGN[_c], _more = chr(_more), _more + 1


def _signs(s: str) -> str:
    """A word as the byte-level model writes it."""
    if s.isascii():
        return "\u0120" + s[1:] if s[0] == " " else s
    return s.encode().decode("latin-1").translate(_SIGN)


class Encoder:
    """Ids of whole texts as the tokenizer gives them, encoding each distinct stretch once.

    A byte-level BPE splits text into words by a pattern and merges inside words only, so the ids of a stretch that ends where
    words end do not depend on what is around it.  A special token that stands in the text, such as ``<|endoftext|>``, gets its own id,
    and no stretch is cut inside it.  Stretches are known by two 64-bit hashes.  The memory is emptied when it has
    ``limit`` stretches, which changes nothing but time.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self._forget()

    def _forget(self) -> None:
        self.names, self.checks, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def _learn(self, names: np.ndarray, checks: np.ndarray, new: list[str]) -> None:
        word = self.tokenizer.model.tokenize
        ids = [[x.id for x in word(_signs(s))] if _WORD(s) else None for s in new]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([new[i] for i in rest], add_special_tokens=False)):
            ids[i] = e.ids
        code = np.arange(len(new)) + len(self.at) - 1
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum([len(x) for x in ids])))
        more = np.fromiter(chain.from_iterable(ids), np.uint32)
        self.flat = np.concatenate((self.flat, more if more.size and more.max() > 0xFFFF else more.astype(np.uint16)))
        to = np.searchsorted(self.names, names)
        self.names, self.checks, self.codes = np.insert(self.names, to, names), np.insert(self.checks, to, checks), np.insert(self.codes, to, code)

    def batch(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.names) > self.limit:
            self._forget()
        sizes = np.array([len(t) for t in texts], np.int64)
        b = np.frombuffer(b"".join(texts), np.uint8)
        starts = stretches(b, np.cumsum(sizes) - sizes)
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        ends = np.append(starts[1:], len(b))
        names, first, code = np.unique(span_hash(b, starts, ends), return_index=True, return_inverse=True)
        checks = span_hash(b, starts[first], ends[first], 1)
        unknown = np.flatnonzero(~self._holds(names, checks))
        if len(unknown):
            self._learn(names[unknown], checks[unknown], [b[starts[i]:ends[i]].tobytes().decode() for i in first[unknown]])
        code = self.codes[np.searchsorted(self.names, names)][code]
        start, n = self.at[code], self.at[code + 1] - self.at[code]
        to = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        ids = self.flat[np.repeat(start - to[:-1], n) + np.arange(to[-1])].astype(np.uint32)
        return np.split(ids, to[np.searchsorted(starts, np.cumsum(sizes))][:-1])

    def _holds(self, names: np.ndarray, checks: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(names), bool)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        held = self.names[at] == names
        if (held & (self.checks[at] != checks)).any():
            raise ValueError("two stretches have one hash")
        return held


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder, whose memory serves all its tasks."""
    return Encoder(path)


# ---- the job ------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, tie: Column, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, tasks: int | None = None) -> None:
    """Encode ``text`` of every row, append ``end_id``, and write ids in ascending doc_id order as shard files.

    Rows are range-partitioned by doc_id (null first; equal ids by ``tie``), encoded after the shuffle and gathered
    into shards of about ``shard_tokens`` ids.  A task holds one shard at a time.  A file is one row of Spark's own text
    writer, so its commit protocol covers it; the writer's line end behind the file's last byte is not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("_tie"))
    rows = rows.repartitionByRange(tasks or n_tasks(spark), F.col("doc_id").asc_nulls_first(), "_tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own = TaskContext.get().partitionId(), encoder(tokenizer)
        names, ids, held, number = [], [], 0, 0

        def shard():
            blob = build(np.concatenate(ids), names, np.array([len(x) for x in ids]))
            return pa.RecordBatch.from_arrays([pa.array([f"{part:07d}-{number:07d}"]), pa.array([blob], pa.binary())], names=["shard", "data"])

        end = np.array([end_id], np.uint32)
        for batch, texts in pieces(batches):
            for d, x in zip(batch.column(0).to_pylist(), own.batch([t or b"" for t in texts])):
                names.append(d)
                ids.append(np.concatenate((x, end)))
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield shard()
                    names, ids, held, number = [], [], 0, number + 1
        if names:
            yield shard()

    files = rows.mapInArrow(run, "shard string, data binary")
    files.select("shard", F.col("data").cast("string").alias("value")).write.partitionBy("shard").option("compression", "none").text(path)


def shard_files(spark, path: str) -> DataFrame:
    """(shard, data) of every shard file; file names give the shards' order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"shard=(\d+-\d+)/", 1).alias("shard"), F.col("content").alias("data"))


def read_documents(spark, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_py())
                ids, at = shard.ids().astype("<u4"), np.concatenate(([0], np.cumsum(shard.lengths)))
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * shard.n_docs), pa.array(shard.doc_ids, pa.int64()), pa.array(at[:-1]), pa.array(shard.lengths), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    docs = keep(shard_files(spark, path).mapInArrow(run, "shard string, doc_id long, at long, n_tokens long, ids_crc32 long"), "read-back")
    sizes = docs.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.substring("shard", 1, 7))
    # Two levels: shards within a task's range, then one number per task.
    parts = sizes.groupBy("part").agg(F.sum("n").alias("m")).withColumn("part_start", F.sum("m").over(Window.orderBy("part")) - F.col("m"))
    inner = F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")
    starts = sizes.withColumn("inner", inner).join(parts, "part").select("shard", (F.col("part_start") + F.col("inner")).alias("base"))
    return docs.join(starts, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_index(docs: DataFrame, tie: Column, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shard files in the shared folder and return what is read back from them.

    A null text is an empty one (only the end id).  Null doc_ids come first; equal doc_ids are adjacent, in the order of
    ``tie``.  Equal rows are documents of their own.  An empty table writes no file and gives no row.  Other columns are
    left out.
    """
    spark = docs.sparkSession
    path = new_path(spark, "wavelet")
    write_shards(docs, tie, path, tokenizer, **options)
    if not path_has_files(spark, path):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_documents(spark, path)


def path_has_files(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(where) and any(s.isDirectory() for s in fs.listStatus(where))
