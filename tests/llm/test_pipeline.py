"""The pipeline against a plain version, and its stages on odd input."""

import random

import brute
import pytest
from test_ops import SCHEMA, near_copy, odd_rows, text_of, token_rows

import corpus_pipeline


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    r = random.Random(12)
    words = [f"{a}{b}{c}" for a in "bcdfghk" for b in "aeiou" for c in "lmnrst"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, say(30)) for i in range(5)]
    docs = []
    for i in range(140):
        kind, t = i % 7, say(r.randrange(60, 200))
        if kind == 1:
            t = near_copy(r, docs[-1][1], 1)
        elif kind == 2:
            t = f"{say(40)} {items[r.randrange(5)][1]} {say(40)}"
        elif kind == 3:
            t = say(r.randrange(1, 60))
        elif kind == 4:
            t = text_of(r, 10) + " #$%" * 60
        docs.append((i, t, "en", r.choice(["a", "a", "b", None]), len(t)))
    docs.append((141, None, None, None, None))
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_run_equals_plain_version(spark, made):
    folder, docs, items = made
    kept = [d for d in docs if brute.keeps(d[1])]
    groups = brute.near([(d[0], d[1]) for d in kept], 5, 80)
    kept = [d for d in kept if groups[d[0]][1] == d[0]]
    leaks = lambda t: any(e <= int(0.15 * n + 1e-9) for e, n in (brute.leak(x, t) for _, x in items))
    kept = [d for d in kept if not leaks(d[1])]
    copies, _, _ = brute.mixture([(d[0], d[3], len(brute.words(d[1])), 0) for d in kept])
    rows = [(d[0], d[1]) for d in sorted(kept) for _ in range(copies[d[0]])]
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert len(rows) > 20 and got == sorted(token_rows(rows))


def test_stages_take_odd_tables(spark, made):
    for rows in (odd_rows(), []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, made[0])
            assert name == "token files" or out.columns == docs.columns
            out.count()
