"""Streams give one result for one file, and for eight part files that come one by one, newest rows first."""

import os
import random

import pytest
from pyspark.sql import functions as F

from signalloom.plans import load
from signalloom.plans.registry import Tables

SF = "/root/testdata/sf0.001"
ORDER = {"documents": "doc_id", "orders": "o_orderkey", "events": "ts"}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("parts"))
    for name in os.listdir(SF):
        if name.removesuffix(".parquet") not in ORDER:
            os.symlink(f"{SF}/{name}", f"{root}/{name}")
    for name, key in ORDER.items():
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        ranked = df.withColumn("_part", F.expr(f"ntile(8) OVER (ORDER BY {key} DESC)")).cache()
        for i in range(1, 9):
            ranked.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(f"{root}/{name}.parquet")
    return root


@pytest.fixture
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("name,streamed", [
    ("stream_ingest", "documents"), ("stream_coverage", "documents"), ("stream_events", "orders"), ("stream_process", "orders"),
    ("tumbling_counts", "events"), ("sliding_report", "events"),
])
def test_batch_cuts_change_nothing(spark, parts, few_partitions, name, streamed):
    load()
    from signalloom.plans import stream_plans as plans

    run = getattr(plans, name)
    whole = run(plans.StreamTables(Tables(spark, SF), streamed))
    cut = run(plans.StreamTables(Tables(spark, parts), streamed, files=1))
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


def test_streamed_events_equal_the_batch(spark, parts, few_partitions):
    load()
    from signalloom.operators.twins import event_twins
    from signalloom.plans import stream_plans as plans

    got = plans.stream_events(plans.StreamTables(Tables(spark, parts), "orders", files=1))
    want = event_twins(Tables(spark, SF).signals).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_repeated_batch_replaces_its_own_version(spark, tmp_path):
    from signalloom.streaming import jobs

    root = str(tmp_path / "log")
    for n, rows in ((0, 5), (1, 7), (1, 7)):
        jobs._write(spark.range(rows).withColumn("k", F.col("id") % 2), root, n)
    assert spark.read.parquet(root).count() == 12 and jobs.newest(spark, root, ["k"]).count() == 7


def _feed(spark, folder, batches, schema):
    """A stream of one file per batch, in the given order."""
    for i, rows in enumerate(batches):
        path = f"{folder}/{i:04d}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        part = next(f for f in os.listdir(path) if f.endswith(".parquet"))
        os.makedirs(f"{folder}/all", exist_ok=True)
        os.rename(f"{path}/{part}", f"{folder}/all/{i:04d}.parquet")
        os.utime(f"{folder}/all/{i:04d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/all")


SIGNAL = "signal_id long, company_id long, type string, title string, url string, stage string, amount_usd_m double, occurred_us long"


def _signals(n, seed):
    rnd, day = random.Random(seed), 86_400_000_000
    word = lambda: rnd.choice("red green blue solar parks grow fast raise round seed".split())
    return [
        (i, rnd.choice([1, 1, 2, None]), rnd.choice(["funding", "launch", "directory"]), f"{word()} {word()} {word()}", f"u{rnd.randrange(9)}",
         rnd.choice(["Seed", "A", None]), rnd.choice([1.0, 1.1, 5.0, None]), rnd.choice([i * day, i * day, rnd.randrange(400) * day, None]))
        for i in range(n)
    ]


def test_events_in_order_never_read_the_log(spark, tmp_path, monkeypatch, few_partitions):
    """50 batches: every batch reads its own rows alone, the state keeps a bounded memory per key, and the result is the batch's."""
    from signalloom.operators.twins import event_twins
    from signalloom.streaming import jobs

    rows = _signals(400, 3)
    monkeypatch.setattr(jobs, "_log", None)
    stream = _feed(spark, str(tmp_path / "in"), [rows[i:i + 8] for i in range(0, 400, 8)], SIGNAL)
    query = jobs.stream_events(stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True, history=8)
    query.awaitTermination()
    steps = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(steps) == 50 and {p["numInputRows"] for p in steps} == {8}
    keys = len({r[1:3] for r in rows})
    assert steps[-1]["stateOperators"][0]["numRowsTotal"] <= keys * (8 + 2)
    got = {tuple(r) for r in jobs.twins_so_far(spark, str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in event_twins(spark.createDataFrame(rows, SIGNAL)).select("signal_id", "stored_id", "counted").collect()}


@pytest.mark.parametrize("history", [6, 64])
def test_late_events_are_folded_in(spark, tmp_path, few_partitions, history):
    from signalloom.operators.twins import event_twins
    from signalloom.streaming import jobs

    rows = _signals(120, 4)
    mixed = sorted(rows, key=lambda r: r[0] + random.Random(r[0]).choice([0, 0, 15, 70]))
    stream = _feed(spark, str(tmp_path / "in"), [mixed[i:i + 20] for i in range(0, 120, 20)], SIGNAL)
    jobs.stream_events(stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True, history=history).awaitTermination()
    got = {tuple(r) for r in jobs.twins_so_far(spark, str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in event_twins(spark.createDataFrame(rows, SIGNAL)).select("signal_id", "stored_id", "counted").collect()}


def _stories(n, seed, weeks):
    rnd, day = random.Random(seed), 86_400_000_000
    word = lambda: rnd.choice([f"word{k:02d}" for k in range(30)])
    out = []
    for i in range(n):
        title = rnd.choice(out)[3] if out and rnd.random() < 0.15 else " ".join(word() for _ in range(rnd.choice([1, 3, 5, 8])))
        ts = i * 7 * weeks * day // n
        out.append((i, rnd.choice(["m", "m", "x", None]), rnd.choice(["a", "b", None]), title, f"u{rnd.randrange(2 * n)}" if rnd.random() < 0.8 else "same", ts if rnd.random() < 0.97 else None))
    return out


def _coverage_of(spark, rows):
    from signalloom.operators.dedup import story_coverage
    from signalloom.streaming.story_state import STORY

    batch = spark.createDataFrame(rows, STORY).withColumn("ord", F.struct("ts_us", "story_id"))
    return {(r["story_id"], r["coverage"]) for r in story_coverage(batch).collect()}


def test_stories_in_order_read_two_weeks(spark, tmp_path, few_partitions):
    from signalloom.streaming import jobs
    from signalloom.streaming.story_state import STORY

    # An undated story counts as the earliest, so it would be late here.
    rows, weeks = [r for r in _stories(130, 5, 13) if r[5] is not None][:120], []
    stream = _feed(spark, str(tmp_path / "in"), [rows[i:i + 20] for i in range(0, 120, 20)], STORY)
    jobs.stream_coverage(stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True, seen=weeks.append).awaitTermination()
    assert {tuple(r) for r in jobs.coverage_so_far(spark, str(tmp_path / "out")).collect()} == _coverage_of(spark, rows)
    # A batch covers two or three weeks and reads these and the ones beside them.
    assert len(weeks) >= 6 and max(map(len, weeks)) <= 5


def test_late_stories_change_what_they_concern(spark, tmp_path, few_partitions):
    from signalloom.streaming import jobs
    from signalloom.streaming.story_state import STORY

    rows = _stories(90, 6, 5)
    mixed = sorted(rows, key=lambda r: r[0] + random.Random(r[0]).choice([0, 0, 25, 60]))
    stream = _feed(spark, str(tmp_path / "in"), [mixed[i:i + 18] for i in range(0, 90, 18)], STORY)
    jobs.stream_coverage(stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    assert {tuple(r) for r in jobs.coverage_so_far(spark, str(tmp_path / "out")).collect()} == _coverage_of(spark, rows)


ITEM = "item_id long, source_id string, title string, summary string, url string, published_us long, kind string, category string, assume_region boolean"


def _headlines(n, seed):
    rnd, day = random.Random(seed), 86_400_000_000
    names = ["Acme Robots", "Blue Gear", "Zed Works", "Quorvex"]
    out = []
    for i in range(n):
        name = rnd.choice(names)
        title = rnd.choice([
            f"{name} raises $ {rnd.choice([5, 6, 40])} Mn in Series {rnd.choice('AB')} round", f"{name} expands to Dubai and Europe", f"{name} raises $ 5 Mn seed round led by Peak Fund"])
        out.append((i, "s", title, "The Indian startup sells software abroad.", f"https://n.example.com/{rnd.randrange(2 * n)}", (11_000 + i) * day, "rss", "leads", True))
    return out


def _state(tables):
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    return [
        rows(tables["companies"], "company_id", "name", "aliases", "markets", "confidence"), rows(tables["signals"], "company_id", "signal_id", "corroborations", "extra_urls"),
        rows(tables["scores"], "company_id", "score", "breakdown"),
    ]


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch, few_partitions):
    """A job dies between two tables of its second batch: readers see the first one; its retry leaves what a recompute gives."""
    from pyspark.errors import StreamingQueryException

    from signalloom.sources.store import Store
    from signalloom.streaming import jobs, write_path

    items, as_of, out = _headlines(45, 7), F.lit("2001-01-01").cast("timestamp"), str(tmp_path / "out")
    stream = _feed(spark, str(tmp_path / "in"), [items[i:i + 15] for i in range(0, 45, 15)], ITEM)
    gated = spark.createDataFrame(items, ITEM)
    from signalloom.operators import gates, intel

    passed = gates.prefilter(intel.classify_intel(gated, keep_all=True).withColumn("intel_pass", F.col("verdict").isNotNull())).where("passed AND route = 'leads'")
    assert passed.count() > 30
    run = lambda: jobs.stream_process(stream, out, str(tmp_path / "query"), once=True, as_of=as_of).awaitTermination()
    want = lambda n: write_path.recomputed(passed.where(F.col("item_id") < n), as_of)
    write = Store.write

    def dies(self, table, df, version):
        if (table, version) == ("signals", 1):
            raise OSError("executor lost")
        return write(self, table, df, version)

    monkeypatch.setattr(Store, "write", dies)
    with pytest.raises(StreamingQueryException):
        run()
    store = jobs.state_store(spark, out)
    assert store.versions() == dict.fromkeys(write_path.TABLES, 0)
    full = want(45)
    seen = lambda: {t: store.read(t, full[t].schema) for t in write_path.TABLES}
    assert _state(seen()) == _state(want(15))
    monkeypatch.setattr(Store, "write", write)
    run()
    assert store.versions() == dict.fromkeys(write_path.TABLES, 2) and _state(seen()) == _state(full)


class _Value:
    """A value of keyed state, with the number of calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.update(None)


class _Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, schema, ttlDurationMs=None):
        return self.states.setdefault(name, _Value())


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def test_types_of_a_company_share_calls_and_are_forgotten_one_by_one():
    from signalloom.streaming.twin_state import TwinState

    def event(i, kind):
        return {"signal_id": i, "type": kind, "url": f"u{i}", "stage": None, "amount_usd_m": None, "occurred_us": 0, "tokens": ["a", "b"]}

    day, handle, state = 86_400_000, _Handle(), TwinState()
    state.init(handle)
    judge = lambda at, *events: {r["signal_id"]: (r["stored_id"], r["beyond"]) for r in state.handleInputRows(("7",), iter(events), _Now(at))}
    kinds = ["funding", "launch", "pain", None, "directory"]
    first = judge(0, *[event(i, k) for i, k in enumerate(kinds)])
    assert first == {i: (i, False) for i in range(5)} and sum(s.calls for s in handle.states.values()) <= 4
    assert judge(20 * day, event(10, "launch")) == {10: (1, False)}
    # 31 days after its last event funding is forgotten, launch is not, and directories never are.
    assert judge(31 * day, event(20, "funding"), event(21, "launch"), event(22, "directory")) == {20: (None, True), 21: (1, False), 22: (4, False)}
    assert judge(32 * day, event(30, "funding"), event(31, "launch")) == {30: (None, True), 31: (1, False)}


def test_urls_share_calls_of_the_state(spark, tmp_path, few_partitions):
    """The state's Python is called per group of urls or titles, not per text, and a batch leaves a file or two per bucket and week."""
    import glob

    from signalloom.streaming import jobs, story_state

    calls = spark.sparkContext.accumulator(0)

    class Counted(story_state.FirstOfUrl):
        def handleInputRows(self, key, rows, timer_values):
            calls.add(1)
            return super().handleInputRows(key, rows, timer_values)

    day, n = 86_400_000_000, 3000
    rows = [(i, "m", "a", f"title {i}", f"u{i}", (i % 30) * day) for i in range(n)]
    stream = _feed(spark, str(tmp_path / "in"), [rows], story_state.STORY)
    before = story_state.FirstOfUrl
    story_state.FirstOfUrl = Counted
    try:
        jobs.stream_coverage(stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    finally:
        story_state.FirstOfUrl = before
    assert 0 < calls.value <= story_state.GROUPS < n / 2
    for log, most in (("arrived", jobs.BUCKETS * jobs.BUCKET_FILES), ("told", 6)):
        assert 0 < len(glob.glob(f"{tmp_path}/out/{log}/batch=0/*/*.parquet")) <= most


def test_a_batch_of_one_file_keeps_all_cores_busy_and_names_are_taken_once(spark, tmp_path, monkeypatch, few_partitions):
    """A batch of one split is judged and extracted by as many tasks as there are cores, and its headlines are read for names once."""
    import glob

    from signalloom.operators import extract
    from signalloom.streaming import jobs, write_path

    calls, leads = [], extract.headline_leads
    counted = lambda items, *a, **k: calls.append(items.columns) or leads(items, *a, **k)
    monkeypatch.setattr(extract, "headline_leads", counted)
    monkeypatch.setattr(write_path, "headline_leads", counted)
    items, out = _headlines(400, 11), str(tmp_path / "out")
    stream = _feed(spark, str(tmp_path / "in"), [items], ITEM)
    jobs.stream_process(stream, out, str(tmp_path / "query"), once=True, as_of=F.lit("2001-01-01").cast("timestamp")).awaitTermination()
    assert len(calls) == 1 and {"url", "published_us"} <= set(calls[0])
    cores = spark.sparkContext.defaultParallelism
    for log in ("passed", "mentions"):
        assert len(glob.glob(f"{out}/{log}/batch=0/*.parquet")) == cores > 1
    ids = lambda df: sorted(r[0] for r in df.select("item_id").collect())
    state = jobs.state_store(spark, out).log("mentions", spark.read.parquet(f"{out}/state/mentions/version=0").drop("bucket").schema)
    assert ids(spark.read.parquet(f"{out}/mentions/batch=0")) == ids(state) == list(range(400))
