"""Leader election and ordered folds against a plain sequential scan."""

import random

import pytest
from pyspark.sql import functions as F

from signalloom.functions.similarity import _jaro_winkler
from signalloom.operators import dedup, merge, resolve, twins
from signalloom.operators.fold import clamped_sum
from signalloom.operators.leaders import assign_leaders


def _jac(a, b):
    return len(a & b) / len(a | b)


def _scan(sets, similar):
    kept, leader = [], {}
    for i in sorted(sets):
        hit = next((k for k in kept if similar(sets[k], sets[i])), None)
        leader[i] = i if hit is None else hit
        if hit is None:
            kept.append(i)
    return leader


@pytest.mark.parametrize("small_block,parts,one_task", [(256, 3, 500_000), (2, 7, 500_000), (4, 5, 0), (256, 2, 20)])
def test_title_leaders_equal_a_sequential_scan(spark, monkeypatch, small_block, parts, one_task):
    import signalloom.operators.leaders as L

    rnd = random.Random(5)
    base = [rnd.sample([f"w{k}" for k in range(30)], rnd.randint(4, 9)) for _ in range(12)]
    sets = {}
    for i in range(260):
        s = set(rnd.choice(base))
        if rnd.random() < 0.6:
            s ^= {f"w{rnd.randrange(30)}"}
        sets[i] = frozenset(s) or frozenset({"w0"})
    rows = spark.createDataFrame([(i, " ".join(sorted(s)) + " " + " ".join(sorted(s))) for i, s in sets.items()], "ord long, title string")
    elect = L.elect_leaders
    monkeypatch.setattr(L, "elect_leaders", lambda a, b, c, n, *more: elect(a, b, c, small_block, *more, one_task=one_task))
    got = {r["ord"]: r["leader"] for r in dedup.near_dup_greedy(rows.repartition(parts)).collect()}
    assert got == _scan(sets, lambda a, b: _jac(a, b) >= 0.75)


def test_long_titles_meet_short_ones(spark):
    words = [f"t{k:03d}" for k in range(60)]
    titles = [" ".join(words[:n]) for n in (30, 33, 38, 42, 45, 60)]
    rows = spark.createDataFrame(list(enumerate(titles)), "ord long, title string")
    sets = {i: frozenset(t.split()) for i, t in enumerate(titles)}
    got = {r["ord"]: r["leader"] for r in dedup.near_dup_greedy(rows).collect()}
    assert got == _scan(sets, lambda a, b: _jac(a, b) >= 0.75)


def test_a_hot_group_of_variants_collapses_to_one_leader(spark):
    rows = spark.range(2000).select(F.col("id").alias("ord"), F.concat(F.lit("alpha beta gamma delta epsilon zeta eta theta v"), "id").alias("title"))
    got = dedup.near_dup_greedy(rows)
    assert got.where("leader <> 0").count() == 0 and got.count() == 2000


def test_unlike_titles_of_one_block_take_few_rounds(spark):
    """20,000 titles share the two tokens that rank first and are all unlike; their block is parted instead of taking 256 a round."""
    from signalloom.operators import blocks
    from signalloom.operators.leaders import elect_leaders

    n = 20_000
    words = F.array(*[F.concat(F.lit(f"w{k}x"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(400)).cast("string")) for k in range(10)])
    sets = spark.range(n).select(F.col("id").alias("ord"), F.array_sort(F.concat(F.array(F.lit("aa"), F.lit("bb")), words)).alias("tokens"))
    order = blocks.ranked(sets).withColumn("r", F.expr("array('aa', 'bb') || array_except(r, array('aa', 'bb'))"))
    rounds = []
    kept, edges = elect_leaders(sets, dedup.prefix_keys(order), dedup._similar_titles(0.75, None), split=blocks.deeper(order), seen=rounds.append)
    assert kept.count() == n and edges is None and max(rounds) < 5


@pytest.mark.parametrize("small_block", [3, 256])
def test_stories_equal_a_sequential_scan(spark, monkeypatch, small_block):
    """Sets of every size from one token on, hot categories, topics missing, far dates."""
    monkeypatch.setattr(dedup, "STORY_BLOCK", small_block)
    rnd, day = random.Random(11), 86_400_000_000
    rows = []
    for i in range(220):
        tokens = rnd.sample([f"tok{k:02d}" for k in range(26)], rnd.choice([1, 1, 2, 2, 3, 4, 5, 6, 7, 9, 14]))
        rows.append((i, rnd.choice(["m", "m", "x", None]), rnd.choice(["a", "b", None]), rnd.choice([rnd.randrange(20 * day), 7 * day, 14 * day, None]), tokens))
    rows.sort(key=lambda r: (r[3] is not None, r[3] or 0, r[0]))
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "ord long, category string, topic string, ts_us long, tokens array<string>")

    def same(a, b):
        if None in (a[1], b[1], a[3], b[3]) or a[1] != b[1] or b[3] - a[3] >= 7 * day:
            return False
        shared, small = len(set(a[4]) & set(b[4])), min(len(a[4]), len(b[4]))
        return shared / small >= 0.6 or shared >= 4 or (a[2] is not None and a[2] == b[2] and shared >= 2)

    got = {r["ord"]: r["leader"] for r in dedup.story_leaders(df.repartition(5)).collect()}
    assert got == _scan({r[0]: r for r in rows}, same)


def test_story_window_and_topic(spark):
    day = 86_400_000_000
    data = [(1, 0, "m", "a", "solar parks grow"), (2, 3 * day, "m", "a", "solar parks shrink fast"), (3, 3 * day, "m", "b", "solar parks shrink slow maybe"),
            (4, 9 * day, "m", "a", "solar parks grow"), (5, 4 * day, "x", "a", "solar parks grow")]
    s = spark.createDataFrame([(t, i, c, k, title + f" {i}", f"u{i}") for i, t, c, k, title in data], "ts_us long, id long, category string, topic string, title string, url string")
    out = dedup.story_coverage(s.withColumn("ord", F.struct("ts_us", "id")))
    assert {r["id"]: r["coverage"] for r in out.collect()} == {1: 3, 4: 1, 5: 1}


def test_fuzzy_keys_lose_no_pair(spark):
    rnd = random.Random(3)
    stems = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(5, 12))) for _ in range(25)]
    names = set(stems)
    for s in stems:
        for _ in range(6):
            k = rnd.randrange(2, len(s))
            names.add(s[:k] + rnd.choice(["", "q", s[k] + s[k], "z"]) + s[k + 1:])
    names = sorted(names)
    df = spark.createDataFrame([(n,) for n in names], "norm string")
    got = {(r["l"], r["r"]) for r in resolve.fuzzy_pairs(df, df).collect()}
    want = {(a, b) for a in names for b in names if a[:2] == b[:2] and len(a) >= 5 and len(b) >= 3 and _jaro_winkler(a, b, False) >= 0.94}
    assert got == want


def test_resolution_follows_domains_and_names(spark):
    m = spark.createDataFrame([
        (1, "Red Widget Labs", None), (2, "Red Widget", "rw.example.com"), (3, "Completely Other", "rw.example.com"),
        (4, "Blue Gear", "bg.example.com"), (5, "Blue Gears", None), (6, "Zed", None)], "mention_id long, name string, domain string")
    got = {r["mention_id"]: r["company_id"] for r in resolve.resolve_entities(m).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def _resolve(spark, rows):
    m = spark.createDataFrame(rows, "mention_id long, name string, domain string").repartition(3)
    return {r["mention_id"]: r["company_id"] for r in resolve.resolve_entities(m).collect()}


def test_a_company_has_one_domain(spark):
    rows = [(1, "Alphabeta", "a.com"), (2, "Alphabeta", "b.com"), (3, "Zedworks", "b.com"), (4, "Zedworks", "c.com"), (5, "Quorvex", "c.com")]
    assert _resolve(spark, rows) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    rows = [(1, "Alphabeta", None), (2, "Alphabeta", "b.com"), (3, "Zedworks", "b.com"), (4, "Zedworks", None), (5, "Zedworks", None)]
    assert _resolve(spark, rows) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_resolution_equals_one_scan_of_all(spark):
    from pyspark.sql import functions as F

    from signalloom.functions.text import norm_name

    rnd = random.Random(3)
    stems = ["alphabeta", "zedworks", "quorvexa", "redwidget", "bluegear", "alphabets", "redwidgets"]
    rows = []
    for i in range(1, 240):
        s = rnd.choice(stems)
        k = rnd.randrange(3, len(s))
        s = rnd.choice([s, s, s[:k] + rnd.choice("qzx") + s[k:]])
        rows.append((i, s, rnd.choice([None, None, None, f"{rnd.choice(stems)}.com", f"{rnd.choice('abc')}.com"])))
    first = {}
    names = {r["name"]: r["norm"] for r in spark.createDataFrame([(r[1],) for r in rows], "name string").select("name", norm_name(F.col("name")).alias("norm")).collect()}
    for i, name, domain in rows:
        first.setdefault((names[name], domain), i)
    import pandas as pd

    whole = resolve._scan(pd.DataFrame([(o, n, d) for (n, d), o in first.items()], columns=["ord", "norm", "domain"]))
    want = {(n, d): c for n, d, c in whole.itertuples(index=False)}
    assert _resolve(spark, rows) == {i: want[names[n], d] for i, n, d in rows}
    assert all(c in first.values() for c in want.values())


def _check_resolution(spark, rows):
    """resolve_entities of (mention_id, name, domain) rows equals one scan of all."""
    import pandas as pd
    from pyspark.sql import functions as F

    from signalloom.functions.text import norm_name

    names = {r["name"]: r["norm"] for r in spark.createDataFrame([(r[1],) for r in rows], "name string").select("name", norm_name(F.col("name")).alias("norm")).collect()}
    first = {}
    for i, name, domain in rows:
        first.setdefault((names[name], domain), i)
    whole = resolve._scan(pd.DataFrame([(o, n, d) for (n, d), o in first.items()], columns=["ord", "norm", "domain"]))
    want = {(n, d): c for n, d, c in whole.itertuples(index=False)}
    assert _resolve(spark, rows) == {i: want[names[n], d] for i, n, d in rows}


def test_a_short_name_resolves_longer_ones(spark):
    assert _resolve(spark, [(1, "Acme", None), (2, "Acmee", None), (3, "Zed", None)]) == {1: 1, 2: 1, 3: 3}
    rnd = random.Random(5)
    stems = ["acme", "acmee", "zedo", "zed", "zedow", "acmeer", "quor", "quorv"]
    _check_resolution(spark, [(i, rnd.choice(stems), rnd.choice([None, None, None, "a.com", "b.com"])) for i in range(1, 60)])


def test_no_set_of_groups_goes_to_one_task(spark, monkeypatch):
    """A domain with a third of all mentions, chains of spellings and domains that join names of other blocks, without Python scans."""
    from pyspark.sql.group import GroupedData

    def gathered(*_a, **_k):
        raise AssertionError("groups are gathered")

    monkeypatch.setattr(GroupedData, "applyInPandas", gathered)
    rnd = random.Random(11)
    stems = ["alphabeta", "zedworks", "quorvexa", "alphabets", "acme", "acmee", "acmes", "beta", "betas"]
    rows = []
    for i in range(1, 400):
        s = rnd.choice(stems)
        s = s if len(s) < 6 or rnd.random() < 0.4 else s[: rnd.randrange(5, len(s))] + rnd.choice("qzx") * rnd.randrange(3) + s[-2:]
        rows.append((i, s, rnd.choice(["hot.com", None, f"{rnd.choice(stems)}.com", f"{rnd.choice('abc')}.com"])))
    _check_resolution(spark, rows)


def test_chunked_event_fold_equals_one_chunk(spark):
    rnd = random.Random(9)
    rows = [(i, 1 if i % 3 else 2, rnd.choice(["funding", "launch"]), f"u{rnd.randrange(60)}", rnd.choice([None, "Seed", "Series A", "Series B"]),
             rnd.choice([None, 1.0, 5.0, 30.0]), rnd.randrange(0, 200) * 86_400_000_000, " ".join(rnd.sample([f"t{k}" for k in range(12)], 4))) for i in range(400)]
    df = spark.createDataFrame(rows, "signal_id long, company_id long, type string, url string, stage string, amount_usd_m double, occurred_us long, title string")
    key = lambda d: {(r["signal_id"], r["stored_id"], r["counted"]) for r in d.collect()}
    whole = key(twins.event_twins(df))
    assert len(whole) == 400
    assert key(twins.event_twins(df, chunk_rows=25)) == whole
    state, want = {}, set()
    for r in sorted(rows):
        d = dict(zip(["signal_id", "company_id", "type", "url", "stage", "amount_usd_m", "occurred_us", "title"], r))
        o = twins.twin_step(state.setdefault((d["company_id"], d["type"]), {}), {**d, "tokens": d["title"].split()})
        want.add((o["signal_id"], o["stored_id"], o["counted"]))
    assert whole == want


def test_two_null_dates_never_twin(spark):
    df = spark.createDataFrame([(1, 1, "directory", "a", None, None, None, "x"), (2, 1, "directory", "b", None, None, None, "x")],
                               "signal_id long, company_id long, type string, url string, stage string, amount_usd_m double, occurred_us long, title string")
    assert {r["stored_id"] for r in twins.event_twins(df).collect()} == {1, 2}


def test_clamped_sum_is_an_ordered_fold(spark):
    rnd = random.Random(1)
    rows = [(k, i * rnd.choice([1, 1]), rnd.choice([-2, -1, 1, 2]) * 0.04) for k in "ab" for i in range(700)]
    got = {r["k"]: r["value"] for r in clamped_sum(spark.createDataFrame(rows, "k string, seq long, d double"), ["k"], "seq", "d", -0.25, 0.25, levels=4, width=8).collect()}
    for k in "ab":
        x = 0.0
        for _, _, d in sorted(r for r in rows if r[0] == k):
            x = min(0.25, max(-0.25, x + d))
        assert abs(got[k] - x) < 1e-9


def test_feedback_hits_the_bound_and_reverses(spark):
    votes = spark.createDataFrame([(i, "s", "src", -1, 1) for i in range(5)] + [(9, "s", "src", 1, -1)], "seq long, sector string, source_id string, prev int, next int")
    assert abs(merge.fold_feedback(votes).first()["weight"] - (0.25 - 0.08)) < 1e-9


def test_assignment_prefers_the_first_leader(spark):
    items = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "d"]), (3, ["b", "c"])], "ord long, tokens array<string>")
    keys = items.select("ord", F.explode("tokens").alias("key"))
    got = {r["ord"]: r["leader"] for r in assign_leaders(items, keys, lambda a, b: F.arrays_overlap(a("tokens"), b("tokens"))).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("width", [3, 1024])
def test_clamped_sum_of_sparse_numbers(spark, width):
    """Sequence numbers far apart, negative ones and a hot key give the fold in order; blocks stay full."""
    from signalloom.operators.fold import dense_positions

    rnd = random.Random(8)
    rows = [(rnd.choice(["hot"] * 5 + ["a", "b"]), s, rnd.choice([-0.08, -0.04, 0.04, 0.08])) for s in rnd.sample(range(-10**18, 10**18), 900)]
    df = spark.createDataFrame(rows, "k string, s long, d double").repartition(5)
    want = {}
    for k, _, d in sorted(rows, key=lambda r: r[1]):
        want[k] = min(0.25, max(-0.25, want.get(k, 0.0) + d))
    got = {r["k"]: r["value"] for r in clamped_sum(df, ["k"], "s", "d", -0.25, 0.25, width=width).collect()}
    assert got == pytest.approx(want)
    placed = dense_positions(df, ["k"], "s", "pos").collect()
    blocks = {}
    for r in placed:
        blocks.setdefault(r["pos"] // 100, []).append(r)
    # Only the last block of each task is not full.
    tasks = {r["pos"] >> 33 for r in placed}
    assert max(map(len, blocks.values())) <= 100 and len(blocks) <= len(rows) / 100 + 2 * len(tasks)
    assert [r["s"] for r in sorted(placed, key=lambda r: r["pos"]) if r["k"] == "hot"] == sorted(r[1] for r in rows if r[0] == "hot")
