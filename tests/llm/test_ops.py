"""The corpus operators against plain versions, on random and on odd input."""

import io
import random
import struct
import zipfile
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import decontam, graph, langid, linededup, minhash, mixing, queries, quality, sharding, substrings, warczip, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, size string, kept boolean, _row int, shard int, taken string"
LONG = " ".join(f"w{i % 977}x{i % 1013}" for i in range(60_000))
VOCABULARY = [f"{a}{b}" for a in "the of ion ert wan dol per qui".split() for b in "a e io un ra mis tor".split()]


def text_of(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def near_copy(r, text, n=2):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(VOCABULARY)
    return " ".join(w)


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, columns named like results."""
    r = random.Random(3)
    base = text_of(r, 80)
    texts = [None, "", " \n\t ", base, base, base.upper(), LONG, "short text", "a\x0bb\x0cc d", "\n\n".join([base] * 3), near_copy(r, base)]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 4}", "x", True, i, 7, "y") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], rows[0], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def random_docs(seed, n=120):
    r = random.Random(seed)
    out, passage = [], text_of(r, 20)
    for i in range(n):
        kind = r.randrange(6)
        if kind == 0 and out:
            t = r.choice(out)[1]
        elif kind == 1 and out:
            t = near_copy(r, r.choice(out)[1], r.randrange(1, 4))
        elif kind == 2:
            t = f"{text_of(r, r.randrange(1, 30))} {passage} {text_of(r, r.randrange(1, 30))}"
        else:
            t = "\n".join(text_of(r, r.randrange(1, 14)) for _ in range(r.randrange(1, 8)))
        out.append((i, t or " "))
    return out


# ---- 1 mixing


def test_mix_equals_plain_version(spark):
    r = random.Random(1)
    docs = [(i, r.choice(["a", "b", "b", "b", "c", "é", None]), r.randrange(0, 60)) for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n long")
    got = mixing.mix_sources(df, F.col("n"), F.lit(0)).collect()
    copies, goal, sizes = brute.mixture([(d, s, n, 0) for d, s, n in docs])
    assert {x.doc_id: x.copies for x in got} == copies
    for s in sizes:
        own = [x for x in got if x.source == s]
        assert abs(own[0].target - goal[s]) < 1e-6 * goal[s] and abs(sum(x.taken for x in own) - goal[s]) <= 120
    assert max(x.copies for x in got) <= 3
    assert mixing.emit(mixing.mix_sources(df, F.col("n"), F.lit(0)), df.columns).count() == sum(copies.values())


def test_mix_odd(odd, empty):
    got = mixing.mix_sources(odd, queries.n_words(F.col("text")), F.xxhash64("text"))
    assert got.count() == odd.count() and got.filter("copies is null or taken <> copies * size or copies > 3").count() == 0
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix_sources(odd, queries.n_words(F.col("text")), F.xxhash64("text")).collect()))
    assert mixing.mix_sources(empty, F.lit(1), F.lit(0)).count() == 0


# ---- 2 archives


@pytest.mark.parametrize("wide", [False, True])
def test_zip_is_read_by_others_and_others_by_us(wide):
    members = [("a.txt", b"x" * 1000), ("dir/b.bin", bytes(range(256))), ("empty", b"")]
    data = warczip.zip_file(members, wide)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert [(n, z.read(n)) for n in z.namelist()] == members and z.testzip() is None
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in members:
            with z.open(zipfile.ZipInfo(n), "w", force_zip64=wide) as f:
                f.write(d)
        z.comment = b"PK\x05\x06 is also in the comment"
    for raw in (data, out.getvalue()):
        read = lambda at, n: raw[at:at + n]  # noqa: E731, B023
        found = warczip.directory(read, len(raw))
        assert [(m.name, read(warczip.data_start(read, m), m.size)) for m in found] == members
    with pytest.raises(ValueError):
        warczip.directory(lambda at, n: b"no archive"[at:at + n], 10)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100)
    raw = packed.getvalue()
    with pytest.raises(ValueError):
        warczip.data_start(lambda at, n: raw[at:at + n], warczip.directory(lambda at, n: raw[at:at + n], len(raw))[0])


def test_archives_round_trip(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (5, "http://a b\n", "<p>x</p>"), (3, "u", None), (4, "u", ""), (7, "u", LONG), (7, "u", LONG), (None, "u", "null id"), (None, None, "<p>x</p>"), (8, "u", "é\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit(1))
    got = warczip.round_trip(pages, archive_bytes=1000).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    by = {}
    for x in got:
        by.setdefault((x.page_id, x.payload_digest), []).append((x.record_type, x.refers_to))
    for i, _, h in rows:
        payload = (h or "").encode()
        found = by[i, warczip.digest(payload)]
        top = last[h or ""] == (-1 if i is None else i)
        assert sorted(found)[0] == (("response", None) if top else ("revisit", last[h or ""])) and all(f == ("revisit", i) for f in sorted(found, key=str)[1:])
    assert {x.payload_bytes for x in got} >= {0, len(LONG), len("null id")}
    assert warczip.round_trip(pages.limit(0)).count() == 0


def test_read_back_payloads(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "page " * i) for i in range(20)], "page_id long, url string, html string")
    from signalloom.llm.common import new_path

    path = new_path(spark, "test")
    warczip.write_archives(pages, path, archive_bytes=300)
    back = warczip.read_records(warczip.read_index(warczip.archive_list(spark, path)))
    assert {(x.page_id, x.url, bytes(x.payload).decode()) for x in back.collect()} == {(i, f"http://h/{i}", "page " * i) for i in range(20)}


# ---- 3 lines


def test_lines_equal_plain_version(spark):
    r = random.Random(5)
    seeds = [text_of(r, r.randrange(2, 9)) for _ in range(14)]

    def line():
        s = r.choice(seeds)
        for _ in range(r.randrange(0, 3)):
            p, k = r.randrange(len(s)), r.randrange(3)
            s = s[:p] + ("" if k == 0 else "é") + s[p + (k < 2):]
        return s

    docs = [(i, "\n".join(line() for _ in range(r.randrange(1, 6)))) for i in range(60)] + [(60, None), (61, ""), (62, " \n \n"), (63, "tiny\ntinz\ntiny")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_lines", F.lit("x"))
    done = linededup.dedup_lines(df, min_chars=8)
    got = {(x.doc_id, p) for x in done.collect() for p in x.removed}
    assert got == brute.lines(docs, 8)
    assert {x.doc_id: x.n_lines for x in done.collect()} == {d: 0 if t is None else len(t.split("\n")) for d, t in docs}
    texts = {x.doc_id: x.text for x in linededup.without_lines(df, done).collect()}
    assert texts == {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in got) for d, t in docs}


def test_lines_odd(odd, empty):
    got = linededup.dedup_lines(odd).collect()
    assert len(got) == odd.count() and linededup.dedup_lines(empty).count() == 0
    assert all(x.removed for x in got if x.doc_id is None and x.n_lines == 1)  # behind all that have an id


# ---- 4 passages


@pytest.mark.parametrize("width", [1, 4, 13])
def test_passages_equal_plain_version(spark, width):
    docs = random_docs(width) + [(500, None), (501, ""), (None, random_docs(width)[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept_text", F.lit(1)).repartition(5)
    want = brute.passages(docs, width)
    got = substrings.repeated_passages(df, width, buckets=3, piece_bytes=700).collect()
    assert len(got) == len(docs)
    seen = {}
    for x in got:
        seen[x.doc_id] = (x.n_words, {i for s in x.removed for i in range(s["first"], s["end"])}, x.kept_text)
    for (d, t), (n, gone) in want.items():
        assert seen[d] == (n, gone, " ".join(w for i, w in enumerate(brute.words(t)) if i not in gone))


def test_passages_odd(odd, empty):
    got = substrings.repeated_passages(odd).collect()
    assert len(got) == odd.count() and substrings.repeated_passages(empty).count() == 0
    assert [x.kept_text for x in got if x.doc_id is None and x.n_words] == [""]


# ---- 5 benchmark


def test_leaks_equal_plain_version(spark):
    r = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(r.randrange(8, 50)))) for i in range(25)] + [(90, "too short"), (91, None), (92, "")]
    docs = []
    for i in range(150):
        w = say(r.randrange(0, 60))
        if i % 3:
            x = r.choice(items[:25])[1].split()
            for _ in range(r.randrange(0, max(1, len(x) * 2 // 10))):
                p, k = r.randrange(len(x)), r.randrange(3)
                x[p:p + (k != 1)] = [] if k == 2 else say(1)
            x = [y.upper() + "," if r.random() < 0.2 else y for y in x]
            w = w[:r.randrange(0, len(w) + 1)] + x + say(r.randrange(0, 30))
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, LONG)]
    got = decontam.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("edits", F.lit("x")), spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    want = {}
    for d, t in docs[:-1]:
        for i, x in items[:25]:
            e, n = brute.leak(x, t)
            if e <= int(n * 0.15 + 1e-9):
                want[d, i] = e
    found = {(x.doc_id, x.item_id): x.edits for x in got}
    assert set(found) <= set(want) and len(want) > 50 and len(found) >= 0.99 * len(want)
    assert sum(found[k] != want[k] for k in found) == 0
    blocks = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=900)
    assert {(x.doc_id, x.item_id): x.edits for x in blocks.collect()} == found


def test_leaks_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, odd_rows()[3][1]), (None, odd_rows()[3][1])], "item_id long, text string")
    got = decontam.contaminated(odd, items)
    assert got.filter("doc_id is null").count() == 2 and decontam.contaminated(empty, items).count() == 0
    assert decontam.contaminated(odd, items.limit(0)).count() == 0
    kept = decontam.clean(odd, items)
    assert kept.columns == odd.columns and kept.filter(F.col("text").contains(odd_rows()[3][1])).count() == 0 and kept.filter("text is null").count() == 3


# ---- 6 shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 50, 333])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), F.lit(n).cast("long"))).collect()]
    assert sorted(got) == list(range(n)) and (n < 16 or got != sorted(got))


def test_shards(spark, odd, empty):
    df = spark.range(1003).withColumn("text", F.lit("same"))
    rows = sharding.shard(df, F.col("id"), F.lit(0)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(by) == 16 and all(sorted(s) == list(range(len(s))) for s in by.values()) and {len(s) for s in by.values()} == {62, 63}
    assert sorted(rows) == sorted(sharding.shard(df.repartition(7), F.col("id"), F.lit(0)).collect())
    got = sharding.shard(odd, F.col("doc_id"), F.xxhash64("text"))
    assert got.count() == odd.count() and got.select("shard", "slot").distinct().count() == odd.count()
    assert sharding.shard(empty, F.col("doc_id"), F.lit(0)).count() == 0


# ---- 7 quality


def test_quality_equals_plain_version(spark, odd, empty):
    r = random.Random(2)
    texts = [t for _, t in random_docs(11)] + ["#$% " * 60, "der " * 70, "a b " * 40, LONG, "é ù\n" * 60, None, ""] + [text_of(r, 60) for _ in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("x"))
    got = {x.doc_id: x for x in quality.cascade(df, counts=True).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in quality.COUNTS) == brute.features(t)[:5]
        assert got[i].kept == brute.keeps(t) == (got[i].failed_rule is None)
    plain = {x.doc_id: x.kept for x in quality.cascade(df, order=[4, 3, 2, 1, 0]).collect()}
    assert plain == {i: x.kept for i, x in got.items()}
    assert quality.cascade(odd).count() == odd.count() and quality.cascade(empty).count() == 0
    assert quality.cascade(odd).columns == [c for c in odd.columns if c != "kept"] + ["kept", "failed_rule"]


def test_order_is_rejection_per_cost():
    order, found = quality.measured_order([b"x " * 20] * 50 + [b"word " * 80])
    rate = [found[i]["rejects"] / found[i]["seconds"] for i in order]
    assert rate == sorted(rate, reverse=True)


# ---- 8 tokens


def test_wavelet_answers():
    g = np.random.default_rng(1)
    for ids in (g.integers(0, 60_000, 5000), np.zeros(10, int), g.integers(0, 3, 4000), np.array([70_000, 2, 2]), np.zeros(0, int)):
        ids = ids.astype(np.uint32)
        s = wavelet.Shard(wavelet.build(ids, [5, None], np.array([len(ids) // 2, len(ids) - len(ids) // 2])))
        assert s.ids().tolist() == ids.tolist() and s.doc_ids == [5, None]
        for i in range(0, len(ids), 97):
            assert s.access(i) == ids[i]
        for t in [*set(ids[:5].tolist()), 123_456, 1]:
            places = np.flatnonzero(ids == t)
            assert s.count(t) == len(places) and s.count(t, 3, 900) == ((places >= 3) & (places < 900)).sum()
            for k in {0, len(places) // 2, len(places) - 1} if len(places) else ():
                assert s.occurrence(t, k) == places[k]
    with pytest.raises(ValueError):
        wavelet.Shard(struct.pack("<4sBQQ", b"none", 1, 0, 0))


def test_encoder_equals_tokenizer():
    e = wavelet.Encoder(queries.default_tokenizer(), limit=50)
    r = random.Random(4)
    texts = ["", " ", "a  b", "x \n\n y\n", "it's  we'll", "<|endoftext|> end", "é ü  x", LONG[:5000], "1234 5.6", "\t\ttab", "emoji 😀😀 ok"]
    texts += ["".join(r.choice("abZ '’é×÷ßжд字界1\n.,!  \t😀\u0085\u00a0\u2003\u3000\u0301s") for _ in range(40)) for _ in range(3000)]
    for t, ids in [*zip(texts, e.batch([t.encode() for t in texts])), *((t, e.batch([t.encode()])[0]) for t in texts)]:
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    assert e.batch([]) == []


def test_encoder_equals_the_tokenizer_as_loaded():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.default_tokenizer())
    e, r = wavelet.Encoder(queries.default_tokenizer(), limit=50), random.Random(8)
    texts = ["foo <|endoftext|> bar", "<|endoftext|>", "a<|endoftext|>b", "x.\n<|endoftext|>\ny", "a <|endoftext|>, b", "<|endoftext|><|endoftext|>", "<|endoftext |>"]
    parts = ["<|endoftext|>", "<|endoftext|>", "<|", "|>", "endoftext", " ", " ", "\n", "  ", "a", "Zb", "'s", ".", ",", "!", ")", "1", "é", "字", "\t", "\u3000", "😀"]
    texts += ["".join(r.choice(parts) for _ in range(12)) for _ in range(3000)]
    for t, ids in zip(texts, e.batch([t.encode() for t in texts])):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, t


def token_rows(rows):
    """(doc_id, start, n_tokens, crc) of (doc_id, text) rows that are in order."""
    t, start, out = wavelet.Encoder(queries.default_tokenizer()).tokenizer, 0, []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_index(spark, odd, empty):
    docs = random_docs(6) + [(300, None), (301, ""), (302, LONG)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start", F.lit("x")).repartition(6)
    got = wavelet.token_index(df, F.xxhash64("text"), queries.default_tokenizer(), shard_tokens=500)
    assert sorted(map(tuple, got.collect())) == token_rows(sorted(docs, key=lambda x: x[0]))
    both = wavelet.token_index(odd, F.xxhash64("text"), queries.default_tokenizer())
    rows = sorted(both.collect(), key=lambda x: x.start)
    assert len(rows) == odd.count() and [r.start for r in rows[1:]] == list(np.cumsum([r.n_tokens for r in rows])[:-1])
    assert [r.doc_id for r in rows] == sorted([r[0] for r in odd_rows()], key=lambda i: (i is not None, i or 0))
    assert wavelet.token_index(empty, F.lit(0), queries.default_tokenizer()).count() == 0


# ---- 9 near duplicates


@pytest.mark.parametrize("width,per_cent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_plain_version(spark, width, per_cent):
    r = random.Random(width)
    docs = random_docs(width + 20, 150)
    base = text_of(r, 120)
    docs += [(1000 + i, near_copy(r, base, r.randrange(1, 5))) for i in range(60)] + [(2000, None), (2001, ""), (2002, "two words"), (2003, "Two WORDS")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit("x")).repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(df, width, per_cent).collect()}
    assert got == brute.near(docs, width, per_cent)


def test_blocks_change_nothing(spark, monkeypatch):
    r = random.Random(8)
    base = text_of(r, 60)
    docs = [(i, near_copy(r, base, r.randrange(1, 7))) for i in range(80)]
    monkeypatch.setattr(minhash, "BLOCK", 7)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(df, 3, 85).collect()} == brute.near(docs, 3, 85)


def test_near_duplicates_odd(odd, empty):
    got = minhash.near_duplicates(odd, 3, 85)
    assert got.count() == odd.count() and minhash.near_duplicates(empty).count() == 0
    left = minhash.without_near_duplicates(odd, 3, 85)
    assert left.columns == odd.columns and minhash.without_near_duplicates(empty).count() == 0
    ids = sorted(r.doc_id for r in left.collect() if r.doc_id is not None)
    assert ids == [0, 1, 2, 3, 6, 7, 8] or ids == [0, 1, 2, 3, 6, 7, 8, 9] or ids == [0, 1, 2, 3, 6, 7, 8, 9, 10]
    assert left.filter("doc_id is null and text is not null").count() == 0  # a copy of document 3


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(50)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# ---- 10 language


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 150 and sum(x.lang == x.lang_pred for x in got) >= 0.95 * len(got) and all(0 <= x.score <= 1 for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    net = langid.fit(odd)
    for n in (net, None):
        rows = langid.predict(odd, n).collect()
        assert len(rows) == odd.count() and all(x.lang_pred == "und" for x in rows if not any(c.isalpha() for c in x.text or ""))
    assert langid.fit(empty) is None and langid.predict(empty, net).count() == 0


def test_windows_cover_whole_texts():
    for n in (1, 127, 128, 129, 1000):
        t = bytes(1 + i % 255 for i in range(n))
        x, row = langid.windows([b"pad", t])
        own = x[row == 1]
        assert len(own) == max(1, -(-n // 128)) and own[-1].tobytes().rstrip(b"\0").endswith(t[-100:])
