"""Quality rules as a short-circuit cascade: cheap and selective rules first."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, kept_columns, mix, pieces

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


class Features:
    """Counts of some texts, each worked out when a rule first asks for it."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.words = Words(texts)
        self._known: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = getattr(self, name)()
        return self._known[name]

    def n_words(self):
        return self.words.counts()

    def word_chars(self):
        """Code points in words: bytes that do not continue a character."""
        w = self.words
        seen = np.concatenate(([0], np.cumsum((w.bytes & 0xC0) != 0x80)))
        return np.bincount(w.doc, weights=seen[w.end] - seen[w.start], minlength=w.n).astype(np.int64)

    def n_symbols(self):
        at = np.flatnonzero(_SYMBOL[self.words.bytes])
        return np.bincount(np.searchsorted(self.words.text_end, at, side="right"), minlength=self.words.n)

    def n_dup_lines(self):
        out = np.zeros(len(self.texts), np.int64)
        for i, t in enumerate(self.texts):
            lines = [x for x in t.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
            out[i] = len(lines) - len(set(lines))
        return out

    def n_repeat_words(self):
        """Words in 3-word windows that the text has twice or more."""
        w = self.words
        at, h = w.windows(3)
        if not len(at):
            return np.zeros(w.n, np.int64)
        h = h ^ mix(w.doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        first, n = at[order[twice]], len(w.doc) + 3
        hit = np.cumsum(np.bincount(first, minlength=n) - np.bincount(first + 3, minlength=n))[:len(w.doc)] > 0
        return np.bincount(w.doc[hit], minlength=w.n)


@dataclass(frozen=True)
class Rule:
    """``fails`` tells, from the features of some texts, which of them the rule rejects."""

    name: str
    fails: Callable[[Features], np.ndarray]


#: The rules of the default cascade; a text that fails any of them is rejected.
RULES = (
    Rule("words", lambda f: f["n_words"] < 50),
    Rule("repeats", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
    Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])),
    Rule("symbols", lambda f: 10 * f["n_symbols"] > 3 * f["n_words"]),
    Rule("lines", lambda f: 2 * f["n_dup_lines"] > np.array([t.count(b"\n") + 1 for t in f.texts])),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured_order(sample: list[bytes], rules=RULES) -> tuple[list[int], list[dict]]:
    """Rules by falling rejection per cost on a sample: each rule's own seconds and share of rejected texts.

    The verdict is the same in every order; only the time differs.
    """
    found = []
    for i, rule in enumerate(rules):
        began = time.perf_counter()
        features = Features(sample)
        rejected = int(np.count_nonzero(rule.fails(features)))
        spent = max(time.perf_counter() - began, 1e-9)
        found.append({"rule": i, "rejects": rejected / max(1, len(sample)), "seconds": spent / max(1, len(sample))})
    return [x["rule"] for x in sorted(found, key=lambda x: (-x["rejects"] / x["seconds"], x["seconds"], x["rule"]))], found


def sampled_texts(docs: DataFrame, rows: int, chars: int) -> list[bytes]:
    """Texts of the ``rows`` rows with the smallest hashes: first the hash they end at, then these rows alone."""
    d = docs.select("text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"))
    last = d.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    if last is None:
        return []
    return [(r[0] or "").encode() for r in d.filter(F.col("h") <= last).select(F.substring("text", 1, chars)).limit(rows).collect()]


def cascade(docs: DataFrame, rules=RULES, order: list[int] | None = None, counts: bool = False, sample_rows: int = 400, sample_chars: int = 20_000) -> DataFrame:
    """Add ``kept`` and ``failed_rule`` (the first rule of the cascade that rejected the row, else null).

    Rows that a rule rejects are not shown to the rules behind it.  ``order`` is measured, if not given, on the
    ``sample_rows`` rows with the smallest hash of doc_id (texts cut to ``sample_chars`` for the measurement only; every verdict is
    on the whole text), so the driver sees a bounded sample.  With ``counts`` all of ``COUNTS`` are added for every row.

    A null text counts as an empty one (all counts 0).  Equal rows get equal verdicts; an empty table gives an
    empty result; columns with the names of results are replaced.
    """
    if order is None:
        order, _ = measured_order(sampled_texts(docs, sample_rows, sample_chars), rules)
    ordered = [rules[i] for i in order]
    names = COUNTS if counts else ()
    kept = kept_columns(docs, (*names, "kept", "failed_rule"))
    fields = [docs.schema[c] for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            texts = [t or b"" for t in texts]
            full = Features(texts)
            failed = np.full(len(texts), -1)
            left, features = np.arange(len(texts)), full
            for i, rule in enumerate(ordered):
                bad = rule.fails(features)
                if bad.any():
                    failed[left[bad]] = i
                    left = left[~bad]
                    if not counts:  # else all texts' counts are needed and known anyhow
                        features = Features([texts[j] for j in left])
                    else:
                        features = _Rows(full, left)
                if not len(left):
                    break
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays += [pa.array(full[n].astype(np.int64)) for n in names]
            arrays += [pa.array(failed < 0), pa.array([None if x < 0 else ordered[x].name for x in failed], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *names, "kept", "failed_rule"])

    from pyspark.sql import types as T

    schema = T.StructType([*fields, *[T.StructField(n, T.LongType()) for n in names], T.StructField("kept", T.BooleanType()), T.StructField("failed_rule", T.StringType())])
    return docs.select(*_with(docs, kept, "text")).mapInArrow(run, schema)


def _with(docs: DataFrame, kept: list[str], text: str) -> list[str]:
    return kept if text in kept else [*kept, text]


class _Rows:
    """Some rows of features that are known for all."""

    def __init__(self, full: Features, rows: np.ndarray):
        self.full, self.rows = full, rows
        self.texts = [full.texts[i] for i in rows]

    def __getitem__(self, name: str) -> np.ndarray:
        return self.full[name][self.rows]
