"""Alignment of two tokenizers over the same bytes, as an Arrow pipeline inside tasks and counts merged by Spark.

A text is encoded with a leading space by a byte-level BPE (A) and by a piece model that adds that space itself (B).  Byte offsets at
which a token of both ends cut the text into groups; a token of A and one of B are linked where their byte ranges overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, pieces
from .wavelet import stretches

#: Bytes of text that are encoded and joined at once; a longer text is a piece of its own.
PIECE = 1 << 20
SHIFT = 1 << 32
COLUMNS = "n_a long, n_b long, n_groups long, n_links long"


# ---- tokenizers ---------------------------------------------------------------------------------


class Encoder:
    """Lists of ids of whole texts; each distinct stretch between cuts is encoded once per worker.

    ``cut(bytes, starts)`` gives starts of stretches that no token crosses and whose ids do not depend on what is around them;
    ``encode(stretches)`` gives their ids; ``tokens`` are the bytes of each id.  Stretches are compared as bytes.  The memory of
    stretches is emptied when it has ``limit`` of them, which changes nothing but time.
    """

    def __init__(self, cut: Callable, encode: Callable, tokens: list[bytes], limit: int = 200_000):
        self.cut, self.encode, self.limit, self.memory = cut, encode, limit, {}
        self.tokens = pa.array(tokens, pa.large_binary())
        self.sizes = pa.array([len(t) for t in tokens], pa.int64())

    def lists(self, texts: list[bytes]) -> pa.LargeListArray:
        joined, ends = b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)
        if not joined:
            return pa.array([[]] * len(texts), pa.large_list(pa.uint32()))
        b = np.frombuffer(joined, np.uint8)
        at = self.cut(b, np.concatenate(([0], ends[:-1])))
        edges = pa.py_buffer(np.append(at, len(b)).astype(np.int64))
        known = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, edges, pa.py_buffer(joined)]).dictionary_encode()
        names = known.dictionary.to_pylist()
        if len(self.memory) > self.limit:
            self.memory.clear()
        new = [s for s in names if s not in self.memory]
        self.memory.update(zip(new, self.encode(new)))
        found = pa.array([self.memory[s] for s in names], pa.large_list(pa.uint32())).take(known.indices)
        edge = found.offsets.to_numpy()
        to = edge[np.concatenate(([0], np.searchsorted(at, ends)))]
        return pa.LargeListArray.from_arrays(pa.array(to - to[0]), found.flatten())

    def bytes_of(self, lists: pa.LargeListArray) -> pa.Array:
        """The joined bytes of each list's tokens."""
        parts = pa.LargeListArray.from_arrays(lists.offsets, self.tokens.take(lists.flatten()))
        return pc.binary_join(parts, pa.scalar(b"", pa.large_binary()))


def _byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: visible Latin-1 signs mean themselves, the others follow from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [c for c in range(256) if c not in set(visible)]
    return {chr(c): c for c in visible} | {chr(256 + i): c for i, c in enumerate(hidden)}


@lru_cache(maxsize=1)
def byte_level(path: str) -> Encoder:
    """Encoder of a byte-level BPE file; strings of special tokens in a text are plain text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model, signs = Tokenizer.from_file(path), _byte_signs()
    model.encode_special_tokens = True
    plain, size = model.get_vocab(with_added_tokens=False), model.get_vocab_size(with_added_tokens=True)
    tokens = [b""] * size
    for token, i in plain.items():
        tokens[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()

    def encode(new: list[bytes]) -> list[list[int]]:
        return [e.ids for e in model.encode_batch_fast([s.decode() for s in new], add_special_tokens=False)]

    return Encoder(stretches, encode, tokens)


@lru_cache(maxsize=1)
def piece_level(path: str) -> Encoder:
    """Encoder of a piece model for texts that begin with the space which the model adds.

    If no piece has a space sign behind another sign, and none has a line feed, merges never cross the places before a run of
    spaces and before a line feed, so texts are cut there; else each text is one stretch.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [
        bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else p.replace("▁", " ").encode()
        for i, p in enumerate(names)
    ]
    apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in names)
    space = model.piece_to_id("▁")

    def cut(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not apart:
            return np.unique(starts[starts < len(b)])
        here = (b == 32) | (b == 10)
        here[1:] &= (b[1:] == 10) | (b[:-1] != 32)
        here[starts[starts < len(b)]] = True
        return np.flatnonzero(here)

    def encode(new: list[bytes]) -> list[list[int]]:
        ids = model.encode([s.removeprefix(b" ").decode() for s in new], num_threads=1)
        for i, s in enumerate(new):
            # The model's own space does not belong to a stretch that begins with a line feed.
            if s[:1] != b" ":
                if ids[i][:1] != [space]:
                    raise ValueError("a piece spans a space and a line feed")
                ids[i] = ids[i][1:]
            elif s == b" ":
                ids[i] = [space]
        return ids

    return Encoder(cut, encode, tokens)


# ---- one piece of texts -------------------------------------------------------------------------


def _ends(lists: pa.LargeListArray, sizes: pa.Array, kind: str) -> pa.Table:
    """Each token's place with its key: its text's place and the byte offset at which it ends there, in one number."""
    ids, parent = lists.flatten(), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(sizes.take(ids))
    starts = lists.offsets.to_numpy()[:-1]
    before = np.concatenate(([0], total.to_numpy()))[starts]
    end = pc.subtract(total, pa.array(before).take(parent))
    key = pc.add(pc.multiply(parent, SHIFT), end)
    return pa.table({"key": key, kind: pa.array(np.arange(len(ids)))})


class Alignment:
    """Groups and links of some texts (bytes, null as None); ``own`` tells which of them have tokens."""

    def __init__(self, texts: list[bytes | None], a: Encoder, b: Encoder):
        spaced = [b" " + t if t else b"" for t in texts]
        lists, want = [e.lists(spaced) for e in (a, b)], pa.array(spaced, pa.large_binary())
        same = [pc.equal(e.bytes_of(x), want) for e, x in zip((a, b), lists)]
        own = pc.and_(pc.and_(*same), pc.greater(pc.binary_length(want), 0))
        self.own = np.flatnonzero(own.to_numpy(zero_copy_only=False))
        self.a, self.b = (x.filter(own) for x in lists)
        ends_a, ends_b = _ends(self.a, a.sizes, "a"), _ends(self.b, b.sizes, "b")
        table = ends_a.join(ends_b, "key", join_type="full outer", use_threads=False).combine_chunks().sort_by("key")
        #: Where tokens of both end: the last tokens of groups.
        both = table.filter(pc.and_(table["a"].is_valid(), table["b"].is_valid()))
        self.last_a, self.last_b, self.cut_key = both["a"], both["b"], both["key"]
        # Between neighbouring ends lies exactly one token of each side, and an overlapping pair has exactly one such stretch.
        a_id, b_id = (pc.cast(x.flatten().take(pc.fill_null_backward(table[k])), pa.int64()) for k, x in (("a", self.a), ("b", self.b)))
        self.links = pa.table({"doc": pc.shift_right(table["key"], 32), "pair": pc.add(pc.multiply(a_id, SHIFT), b_id)})

    def _per_text(self, keys) -> np.ndarray:
        return np.bincount(np.asarray(pc.shift_right(keys, 32)), minlength=len(self.own))

    def counts(self) -> dict[str, np.ndarray]:
        links = np.bincount(np.asarray(self.links["doc"]), minlength=len(self.own))
        return {"n_a": np.diff(self.a.offsets), "n_b": np.diff(self.b.offsets), "n_groups": self._per_text(self.cut_key), "n_links": links}

    def group_lists(self) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        """The ids of each group, over all texts."""
        return tuple(
            pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.asarray(last) + 1))), x.flatten())
            for last, x in ((self.last_a, self.a), (self.last_b, self.b))
        )

    def group_offsets(self) -> pa.Array:
        return pa.array(np.concatenate(([0], np.cumsum(self._per_text(self.cut_key)))))

    def written(self) -> list[str]:
        """Groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        comma, bar, stop = (pa.scalar(s, pa.large_string()) for s in ",|;")
        sides = [
            pc.binary_join(pa.LargeListArray.from_arrays(x.offsets, pc.cast(x.flatten(), pa.large_string())), comma) for x in self.group_lists()
        ]
        groups = pc.binary_join_element_wise(*sides, bar)
        return pc.binary_join(pa.LargeListArray.from_arrays(self.group_offsets(), groups), stop).to_pylist()

    def pair_counts(self) -> tuple[pa.Table, pa.Table]:
        """((doc, pair, times), (pair, number of texts that hold it) in order of pairs)."""
        held = self.links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        known = held.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
        return held, known


# ---- the jobs -----------------------------------------------------------------------------------

_DIGEST = f"doc_id long, {COLUMNS}, groups_sha256 string"
_PIECE = "piece string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, n_pairs array<long>, held binary, pair array<long>, n array<long>"
_NAMES = [f.split()[0] for f in _PIECE.split(", ")]


def _pack(held: pa.Table, known: pa.Table, n: int) -> tuple[np.ndarray, bytes]:
    """Each text's number of pairs, and compressed: their codes (places in ``known``) as steps within the text, and their times."""
    code = np.asarray(pc.index_in(held["pair"], value_set=known["pair"].combine_chunks())).astype(np.int64)
    doc = np.asarray(held["doc"])
    order = np.argsort(doc * SHIFT + code)
    doc, code, times = doc[order], code[order], np.asarray(held["count_all"])[order]
    sizes = np.bincount(doc, minlength=n)
    step = np.diff(code, prepend=0)
    first = np.cumsum(sizes) - sizes
    first = first[sizes > 0]
    step[first] = code[first]
    both = np.concatenate((step, times)).astype("<u4")
    # All low bytes first, then the next ones, which compresses better.
    return sizes, zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(blob: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    both = np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    step, times = np.split(both, 2)
    total, first = np.cumsum(step), np.cumsum(sizes) - sizes
    base = np.concatenate(([0], total))[first]
    return total - np.repeat(base, sizes), times


def _encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per piece of texts: its documents' figures and pairs, and the piece's distinct pairs with their partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, a, b, number = TaskContext.get().partitionId(), byte_level(a_path), piece_level(b_path), 0
        for batch, texts in pieces(batches, limit=PIECE):
            found = Alignment(texts, a, b)
            held, known = found.pair_counts()
            per_doc, blob = _pack(held, known, len(found.own))
            columns = {**found.counts(), "n_pairs": per_doc}
            spread = {k: np.zeros(len(texts), np.int64) for k in columns}
            for k, v in columns.items():
                spread[k][found.own] = v
            sha = [""] * len(texts)
            for i, s in zip(found.own, found.written()):
                sha[i] = hashlib.sha256(s.encode()).hexdigest()
            row = [
                f"{part}-{number}", batch.column(0).to_pylist(), *(spread[k] for k in ("n_a", "n_b", "n_groups", "n_links")), sha, spread["n_pairs"],
                blob, np.asarray(known["pair"]), np.asarray(known["count_all"]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=_NAMES)
            number += 1

    longs = pa.list_(pa.int64())
    types = [pa.string(), longs, longs, longs, longs, longs, pa.list_(pa.string()), longs, pa.binary(), longs, longs]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECE)


def _pair_rows(encoded: DataFrame) -> DataFrame:
    zipped = F.posexplode(F.arrays_zip("pair", "n")).alias("code", "x")
    return encoded.select("piece", zipped).select("piece", "code", F.col("x.pair").alias("pair"), F.col("x.n").alias("n"))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pair").agg(F.sum("n").alias("count"))


def link_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a, b, n_docs): in how many documents a token of A and one of B overlap somewhere; the tasks' partial counts are added up."""
    total = _merged(_pair_rows(_encoded(docs, a_path, b_path)))
    return total.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(SHIFT - 1).cast("int").alias("b"), F.col("count").alias("n_docs"))


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, groups): each document's groups in order, as an array of (a: ids of A, b: ids of B); nulls and ties as in `align`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), piece_level(b_path)
        for batch, texts in pieces(batches, limit=PIECE):
            found = Alignment(texts, a, b)
            sides = [pc.cast(x, pa.list_(pa.int32())) for x in found.group_lists()]
            n = np.zeros(len(texts), np.int64)
            n[found.own] = np.diff(found.group_offsets())
            both = pa.StructArray.from_arrays(sides, names=["a", "b"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), both)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "groups"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: tokens of A and B, groups, links, links to the best partner of their A token, and the links' counts.

    A pair's count is the number of documents of the whole table that hold it linked; ``n_best`` counts the links whose count is the
    highest of their A id, ties included; ``count_sum`` adds the counts of all links.  ``groups_sha256`` is the digest of the groups
    as ``a1,a2|b1;a3|b2,b3``.

    Texts are cut into pieces of about ``PIECE`` bytes, a longer text being one of its own, and a piece is encoded once.  Only a
    piece's distinct pairs with their partial counts are shuffled, so a frequent pair is one row per piece, and only these come back.
    The highest counts are a row per id of A's vocabulary.  A null or empty text, and one whose tokens do not give back its bytes,
    has zeros and an empty digest.  A null doc_id stays null; rows with equal doc_ids, and repeated rows, are documents of their own.
    Other columns are left out; an empty table gives none.
    """
    encoded = keep(_encoded(docs, a_path, b_path), "aligned")
    rows = _pair_rows(encoded)
    counts = keep(_merged(rows).withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    judged = counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    verdicts = rows.select("piece", "code", "pair").join(judged, "pair").select(F.col("piece").alias("of"), "code", "count", "best")

    def finish(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(theirs["code"]))
        count, top = (np.asarray(theirs[k])[order] for k in ("count", "best"))
        one = {k: mine[k][0].as_py() for k in mine.column_names}
        sizes = np.array(one["n_pairs"], np.int64)
        code, times = _unpack(one["held"], sizes)
        edge = np.concatenate(([0], np.cumsum(sizes)))
        add = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[edge])
        out = {k: one[k] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        out |= {"groups_sha256": one["sha"], "n_best": add(times * top[code]), "count_sum": add(times * count[code])}
        return pa.table({k: pa.array(v, pa.string() if k == "groups_sha256" else pa.int64()) for k, v in out.items()})

    mine = encoded.drop("pair", "n").groupBy("piece")
    return mine.cogroup(verdicts.groupBy("of")).applyInArrow(finish, f"{_DIGEST}, n_best long, count_sum long")
