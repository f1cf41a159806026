"""Identifiers, filter audit and token alignment against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import LONG, SCHEMA, odd_rows, random_docs

from signalloom.llm import align, audit, identifiers, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


# ---- identifiers --------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        double = [2 * d - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(double) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m[0])]


def noise(r):
    parts = ["a", "b1", ".", "@", "@x.y", "+", "+1 ", "(", ") ", "-", " ", "4", "255", "1.2.3.4", "999", "4111 1111 1111 1111", "é", "\n", "00", "%", "_", "x-", "c.d", ".."]
    return "".join(r.choice(parts) for _ in range(r.randrange(40)))


def test_plain_spans_equal_patterns():
    r = random.Random(5)
    texts = [noise(r) for _ in range(4000)] + ["1" * 5000, "a." * 3000, "+1" + " " * 3000, "0" * 4000 + "1.2.3.4", "4" * 16 + " ", "1.1.1.1.1.1.1.1.256"]
    for t in texts:
        assert [s[:3] for s in identifiers.find(t) if s[3]] == plain_spans(t), t[:200]


NAME, PHONE, CARD, IP = "jan.34@mail7.example.com", "+1 (017) 555-7713", "4111 1111 1111 1111", "192.168.1.2"
DISGUISED = {
    "jan.34 at mail7 dot example dot com": NAME, "jan.34 [at] mail7 [dot] example [dot] com": NAME, "jan.34(at)mail7.example.com": NAME,
    "jan.34{AT}mail7{DOT}example{DOT}com": NAME, "jan.34＠mail7.example.com": NAME, "jаn.34@mаil7.exаmple.cоm": NAME, "j​an.34@mail7.example.com": NAME,
    "jan.34 @ mail7 . example . com": NAME, "jan.34%40mail7.example.com": NAME, "jan.34&#64;mail7&#46;example&#46;com": NAME, "jan.34ATmail7DOTexampleDOTcom": NAME,
    "jan punkt 34 at mail7 punkt example punkt com": NAME, "jan.34 arroba mail7 punto example punto com": NAME, "jan.34 at mail7.example.com": NAME,
    "plus one zero one seven five five five seven seven one three": "+10175557713", "+1 (zero one seven) five five five-seven seven one three": "+1 (017) 5557713",
    "+1 (O17) 555-77I3": PHONE, "＋1 (017) 555‑7713": PHONE, "plus un zéro un sept cinq cinq cinq sept sept un trois": "+10175557713",
    "４１１１ １１１１ １１１１ １１１１": CARD, "four " + " ".join(["one"] * 15): CARD.replace(" ", ""), "4111 - 1111 - 1111 - 1111": CARD.replace(" ", "-"),
    "192[.]168[.]1[.]2": IP, "192 dot 168 dot 1 dot 2": IP, "one nine two dot one six eight dot one dot two": IP, "192․168․1․2": IP,
}


@pytest.mark.parametrize("hidden", DISGUISED)
def test_disguises_are_found_in_place(hidden):
    for before, after in (("", ""), ("Éine Zeile, ", ". Und mehr"), ("x\n", "\ny")):
        found = identifiers.find(before + hidden + after)
        assert [(s[1], s[2], s[4]) for s in found if not s[3]] == [(len(before), len(before) + len(hidden), DISGUISED[hidden])]


@pytest.mark.parametrize("text", [
    "look at example.com", "see you at polka dot dress", "we met at the dot com boom", "one two three", "le point de vue", "un deux trois", "at once. It",
    f"{NAME} one", f"{PHONE} un homme", f"{PHONE} one two", "plus one", "meet at 5 (five) o'clock", "1 - 2 - 3", "Punkt. Und", "é à ü ñ", "a@b", "(at) home",
])
def test_clean_words_are_left_alone(text):
    assert [s[:3] for s in identifiers.find(text)] == plain_spans(text)


def test_identifiers_odd_and_masked(spark):
    rows = odd_rows() + [(90, f"é {NAME} and jan [at] host [dot] org.", None, None, None, None, None, None, None), (91, f"{LONG} {PHONE}", *[None] * 7)]
    rows.append(rows[-1])
    docs = table(spark, rows).withColumn("spans", F.lit(1))
    out = identifiers.identifiers(docs)
    assert out.columns == [*docs.columns] and out.count() == len(rows)
    got = {r["doc_id"]: r for r in out.filter("doc_id >= 90").collect()}
    assert [(s["kind"], s["start"], s["base"], s["identifier"]) for s in got[90]["spans"]] == [("email", 2, True, NAME), ("email", 31, False, "jan@host.org")]
    assert [(s["kind"], s["start"]) for s in got[91]["spans"]] == [("phone", len(LONG) + 1)]
    assert out.filter("text IS NULL").selectExpr("sum(size(spans))").first()[0] == 0
    mask = {r["doc_id"]: r["text"] for r in identifiers.masked(docs).filter("doc_id >= 90 OR doc_id = 0").collect()}
    assert mask == {0: None, 90: "é [email] and [email].", 91: f"{LONG} [phone]"}
    assert identifiers.identifiers(docs.limit(0)).collect() == []


def test_identifier_query(spark, tmp_path):
    rows = [(1, f"{NAME}, {IP}, {PHONE}, {CARD}"), (2, None), (3, ""), (4, "jan at host dot org")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in queries.QUERIES["op11_personal_data"](spark, str(tmp_path)).collect()}
    base = "email:0:24,ip:26:37,card:58:77,phone:39:56"
    none = hashlib.sha256(b"").hexdigest()
    assert got[1]["spans"] == base and got[1]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert [got[1][f"n_{k}"] for k in identifiers.KINDS] == [1] * 4
    for i, spans in ((2, ""), (3, ""), (4, "email:0:19")):
        assert (got[i]["n_email"], got[i]["base_sha256"], got[i]["spans"]) == (0, none, spans)


# ---- filter audit -------------------------------------------------------------------------------


def audit_rows(docs, labels):
    """docs: (doc_id, text, lang); labels: {doc_id: (quality, toxic)}."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    fails = []
    for d, t, lang in docs:
        t = t or ""
        w = brute.words(t)
        failed = set()
        failed |= {"A"} if len(w) < 200 else set()
        failed |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        failed |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else set()
        failed |= {"D"} if any(c in t for c in "#$%&*|") else set()
        failed |= {"E"} if d is not None and first[t] < d else set()
        fails.append((lang or "", failed, *labels.get(d, (0, 0))))
    out = set()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        rows = []
        for order in map("".join, permutations("ABCDE")):
            for i, x in enumerate(order):
                before = set(order[:i])
                gone = [f for f in mine if x in f[1] and not f[1] & before]
                rows.append((
                    part, order, i + 1, sum(not f[1] & (before | {x}) for f in mine), len(gone), sum(x in f[1] and bool(f[1] & before) for f in mine),
                    sum(f[1] == {x} for f in mine), sum(f[2] == 1 for f in gone), sum(f[3] == 1 for f in gone),
                ))
        total = Counter()
        for r in rows:
            total[r[1][r[2] - 1]] += r[4]
        out |= {(*r, total[r[1][r[2] - 1]]) for r in rows}
    return out


def test_audit_equals_plain_version(spark):
    r = random.Random(8)
    docs = [(d, t * r.choice([1, 1, 6]) + r.choice(["", "", " # A", " XYZ" * 40]) if t else t, r.choice(["en", "de", None])) for d, t in random_docs(21, 150)]
    docs += [(500 + i, docs[i % 7][1], "en") for i in range(60)] + [docs[0], docs[0], (None, docs[0][1], "en"), (None, docs[0][1], "en"), (None, None, None), (600, None, "de"), (601, "", "de")]
    docs.append((docs[3][0], docs[3][1], "xx"))
    labels = {d: (r.randrange(2), r.randrange(2)) for d, _, _ in docs[::2] if d is not None}
    lines = [(d, *x) for d, x in labels.items()] + [(d, 0, None) for d in list(labels)[:9]] + [(None, 1, 1), (99999, 1, 1)]
    frame = table(spark, [(d, t, lang, 1) for d, t, lang in docs], "doc_id long, text string, lang string, kept int")
    got = audit.audit(frame, table(spark, lines, "doc_id long, quality int, toxic int"))
    assert {tuple(x) for x in got.collect()} == audit_rows(docs, labels)
    assert got.count() == 600 * len({x[2] for x in docs})


def test_audit_odd(spark):
    empty = table(spark, [], "doc_id long, quality int, toxic int")
    rows = odd_rows()
    assert {tuple(x) for x in audit.audit(table(spark, rows), empty).collect()} == audit_rows([(x[0], x[1], x[2]) for x in rows], {})
    assert audit.audit(table(spark, []), empty).collect() == []


def test_words_and_counts():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 5, 100, 1237):
        w, times = r.integers(0, 1 << 32, n, dtype=np.uint32), r.integers(1, 9, n)
        bits = (w[:, None] >> np.arange(32, dtype=np.uint32) & 1).astype(np.int64)
        assert (audit.positional_counts(w) == bits.sum(0)).all()
        if n:
            assert (audit.weighted_counts(w, times) == (bits * times[:, None]).sum(0)).all()
    assert [bin(audit.word(f)).count("1") for f in (0, 1, 3, 31)] == [32, 16, 8, 1]


def test_long_text_is_counted_in_stretches(monkeypatch):
    t = ("ab cd\n" * 500 + "x" * 300 + "\t" + " ".join(f"w{i}" for i in range(900)) + "  ").encode()
    want = audit.failures(t)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(audit, "STRETCH", size)
        assert audit.failures(t) == want


# ---- token alignment ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_alignment(models, texts):
    """Per text (n_a, n_b, groups, links as id pairs), or None without tokens."""
    a, b = models
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in visible} | {chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(visible)))}
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            out.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = np.searchsorted(ends_a, cut) + 1, np.searchsorted(ends_b, cut) + 1
            groups.append((ids_a[i:to_a], ids_b[j:to_b]))
            i, j = to_a, to_b
        links = [
            (x, y) for x, e, n in zip(ids_a, ends_a, map(len, bytes_a)) for y, f, m in zip(ids_b, ends_b, map(len, bytes_b)) if max(e - n, f - m) < min(e, f)
        ]
        out.append((len(ids_a), len(ids_b), groups, links))
    return out


def plain_digests(models, docs):
    found = plain_alignment(models, [t for _, t in docs])
    count, most = Counter(p for f in found if f for p in set(f[3])), defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    rows = []
    for (d, _), f in zip(docs, found):
        if f is None:
            rows.append((d, 0, 0, 0, 0, "", 0, 0))
            continue
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        sha = hashlib.sha256(text.encode()).hexdigest()
        rows.append((d, f[0], f[1], len(f[2]), len(f[3]), sha, sum(count[p] == most[p[0]] for p in f[3]), sum(count[p] for p in f[3])))
    return rows, found, count


def alignment_docs(seed, n=60):
    r = random.Random(seed)
    odd = [None, "", " ", "  ", " a", "a  b\n\n c\n d", " \n \n", "<s> </s> <unk> <0x41> <|endoftext|> x", "a ▁ b", "é漢字 \U0001f600​ x", "\r\n\t a \x0b", "\n", "naïve café ", "1234567 89,000.5"]
    parts = ["the", " the", "a", " ", "  ", "\n", "é", "漢", ".", ",", "1", "'s", " of", "\t", "tokenization", " Straße", "\U0001f600", " www.x.org/"]
    made = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(n)]
    return list(enumerate(odd + made + [t for _, t in random_docs(seed, 20)]))


def test_alignment_equals_plain_version(spark, models, monkeypatch):
    docs = alignment_docs(4) + [(1, "the the"), (1, "the the"), (None, "of the"), (None, None)]
    want, found, count = plain_digests(models, docs)
    frame = table(spark, docs, "doc_id long, text string").withColumn("n_a", F.lit("x")).repartition(3)
    got = align.align(frame, A, B)
    assert [f.name for f in got.schema] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    pairs = {(x["a"], x["b"]): x["n_docs"] for x in align.link_counts(frame, A, B).collect()}
    assert pairs == count
    lists = sorted(((x["doc_id"], [(g["a"], g["b"]) for g in x["groups"]]) for x in align.groups(frame, A, B).collect()), key=repr)
    assert lists == sorted(((d, [(list(x), list(y)) for x, y in f[2]] if f else []) for (d, _), f in zip(docs, found)), key=repr)


def test_alignment_in_many_pieces(spark, models, monkeypatch):
    """Pieces of a few bytes give the same rows as one."""
    docs = alignment_docs(9, 20)
    want = sorted(plain_digests(models, docs)[0], key=repr)
    monkeypatch.setattr(align, "PIECE", 200)
    assert sorted(map(tuple, align.align(table(spark, docs, "doc_id long, text string").coalesce(1), A, B).collect()), key=repr) == want


def test_alignment_odd(spark):
    got = align.align(table(spark, odd_rows()), A, B).collect()
    assert len(got) == len(odd_rows()) and all(x["n_links"] == x["n_a"] + x["n_b"] - x["n_groups"] for x in got)
    assert {(x["n_a"], x["groups_sha256"]) for x in got if x["doc_id"] in (0, 1)} == {(0, "")}
    assert align.align(table(spark, []), A, B).collect() == []


def test_lists_equal_tokenizers(models):
    a, b = models
    texts = [t for _, t in alignment_docs(17, 1500) if t and "▁" not in t]
    spaced = [(" " + t).encode() for t in texts]
    assert align.byte_level(A).lists(spaced).to_pylist() == [a.encode(" " + t, add_special_tokens=False).ids for t in texts]
    assert align.piece_level(B).lists(spaced).to_pylist() == [b.encode(t) for t in texts]
