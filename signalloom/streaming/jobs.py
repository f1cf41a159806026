"""Structured Streaming jobs.

Every job appends what arrives to a log, one version per micro-batch, and a batch that runs again replaces only its own
version.  No row is dropped for being late: there are no watermarks on dates inside the items.  Event twins and first-told stories
are keyed state; a batch reads the log only for keys whose late rows lie before what the state still holds.  So the cost of a batch
does not grow with history, and results do not depend on how the input was cut into batches or in which order it came; readers
take the newest version of each row.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed_values as fv
from ..operators import dedup, extract, gates, intel
from ..operators.state import cut
from ..operators.twins import fold_twins
from ..sources.store import Store
from . import story_state, twin_state, write_path

#: Folders of a log by hash of its key, so that a look-up of some keys reads some folders.
BUCKETS = 64
#: Files of a bucket that a batch writes at most.
BUCKET_FILES = 2


def _log(spark, root: str, upto: int, schema) -> DataFrame:
    """All versions of a log up to a batch, with their batch number."""
    full = T.StructType([*(T.DataType.fromDDL(schema) if isinstance(schema, str) else schema).fields, T.StructField("batch", T.IntegerType())])
    try:
        log = spark.read.schema(full).option("basePath", root).parquet(f"{root}/batch=*")
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], full)
    return log.where(F.col("batch") <= upto)


def _write(df: DataFrame, root: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/batch={batch}")


def _write_buckets(spark, df: DataFrame, root: str, batch: int, *keys: str) -> DataFrame:
    """Write a batch by hash of its keys, and read it again with ``spark``: a state operator's output must be computed once.

    A bucket is dealt over ``BUCKET_FILES`` tasks, so that a batch does not leave a file per bucket and task of the state.
    """
    rows = df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64(*df.columns), F.lit(BUCKET_FILES)))
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/batch={batch}")
    return spark.read.schema(rows.schema).parquet(f"{root}/batch={batch}")


def _spread(batch: DataFrame) -> DataFrame:
    """A batch that comes as few tasks, such as a file of one row group, dealt over all cores: rules over its texts cost far more than that."""
    cores = batch.sparkSession.sparkContext.defaultParallelism
    return batch.repartition(cores) if batch.rdd.getNumPartitions() < cores else batch


def _write_weeks(df: DataFrame, root: str, batch: int) -> None:
    """Write a batch by week, with a file per week unless it is large."""
    df.hint("rebalance", "week").write.mode("overwrite").partitionBy("week").parquet(f"{root}/batch={batch}")


def _buckets(rows: DataFrame) -> list[int]:
    """The buckets of some rows, ``BUCKETS`` numbers at most."""
    return [r[0] for r in rows.select("bucket").distinct().collect()]


@contextmanager
def _keyed_state(spark, once: bool):
    """Settings that a query with keyed state takes over when it starts.

    Without them a run over what is available would go on for ever, since timers of the state ask for batches without data.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if once:
        wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _start(df: DataFrame, each, checkpoint: str, once: bool) -> StreamingQuery:
    w = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def newest(spark, root: str, keys: list[str]) -> DataFrame:
    """The newest version of each key of a log whose batches each hold whole keys."""
    log = spark.read.option("basePath", root).parquet(f"{root}/batch=*")
    last = log.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return log.join(last, [*keys, "batch"], "left_semi").drop("batch")


# ---------------------------------------------------------------- ingest
def stream_ingest(items: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Log the first row per url of each micro-batch (``ord``, url, title, published_at, structured)."""
    def each(batch: DataFrame, number: int) -> None:
        _write(dedup.url_dedup(batch, ["ord"]).drop("url_hash"), root, number)

    return _start(items, each, checkpoint, once)


def ingested(spark, root: str, as_of) -> DataFrame:
    """Items by url with their status; age is judged against ``as_of``, never against other items."""
    return dedup.ingest(spark.read.option("basePath", root).parquet(f"{root}/batch=*").drop("batch"), as_of)


def stream_process(items: DataFrame, root: str, checkpoint: str, once: bool = False, as_of: Column | None = None) -> StreamingQuery:
    """Judge, gate and extract each micro-batch into logs: ``mentions``, ``intel``, ``voice`` and ``touched`` (names to rescore).

    With ``as_of`` the companies that a batch mentions are also derived and scored anew, in the tables of `state_store`, which become
    visible together (`write_path.apply_batch`); items then need ``url`` and ``published_us``, and mentions have them too.
    Limit the batch at the source with ``maxFilesPerTrigger``.
    """
    def each(batch: DataFrame, number: int) -> None:
        judged = intel.classify_intel(_spread(batch), keep_all=True, only=F.col("category") == "intel").withColumn("intel_pass", F.col("verdict").isNotNull())
        _write(gates.prefilter(judged, with_hits=False).where("passed"), f"{root}/passed", number)
        passed = batch.sparkSession.read.parquet(f"{root}/passed/batch={number}")
        dated = [] if as_of is None else ["url", "published_us"]
        leads = gates.min_confidence(extract.headline_leads(_spread(passed.where("route = 'leads'").select("item_id", "title", "summary", *dated))))
        _write(leads, f"{root}/mentions", number)
        _write(passed.where("route = 'intel'").select("item_id", "title", "verdict.*"), f"{root}/intel", number)
        _write(passed.where("route = 'voice'").select("item_id", "title", "summary"), f"{root}/voice", number)
        done = batch.sparkSession.read.parquet(f"{root}/mentions/batch={number}")
        _write(done.select("name").distinct(), f"{root}/touched", number)
        if as_of is not None:
            # The names were taken out of the headlines once; the state has the same mentions.
            write_path.apply_batch(state_store(batch.sparkSession, root), write_path.known_by_name(done), number, as_of)

    return _start(items, each, checkpoint, once)


def state_store(spark, root: str) -> Store:
    """Mentions, companies, signals and scores of the stream, as the newest manifest names them."""
    return Store(spark, f"{root}/state", "company_id")


# ---------------------------------------------------------------- events
def stream_events(signals: DataFrame, root: str, checkpoint: str, once: bool = False, history: int = twin_state.HISTORY) -> StreamingQuery:
    """Twin detection over a stream: logs ``arrived`` events and, for every event that a batch judges, its ``twins`` row.

    The memory of each (company, type) is streaming state.  An event that arrives late is folded in at its place in the order of
    signal_id: within the last ``history`` events of its key in the state, from before them out of the key's bucket of the log.
    """
    def each(batch: DataFrame, number: int) -> None:
        arrived = _write_buckets(batch.sparkSession, batch, f"{root}/arrived", number, *twin_state.KEYS)
        verdict = ["signal_id", "stored_id", "counted", *twin_state.KEYS]
        twins = arrived.where("NOT beyond").select(*verdict)
        keys = arrived.where("beyond").select(*[F.col(k).alias(f"_{k}") for k in twin_state.KEYS], "bucket").distinct()
        buckets = _buckets(keys)
        if buckets:
            log = _log(batch.sparkSession, f"{root}/arrived", number, arrived.schema).where(F.col("bucket").isin(buckets))
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in twin_state.KEYS]
            rows = cut(log.join(keys.drop("bucket"), same[0] & same[1], "left_semi").dropDuplicates(["signal_id"]))
            again = fold_twins(rows).join(rows.select("signal_id", *twin_state.KEYS), "signal_id")
            twins = twins.unionByName(again.select(*verdict))
        _write(twins, f"{root}/twins", number)

    with _keyed_state(signals.sparkSession, once):
        return _start(twin_state.judged(signals, history), each, checkpoint, once)


def twins_so_far(spark, root: str) -> DataFrame:
    """The newest verdict on each event: signal_id, stored_id, counted."""
    return newest(spark, f"{root}/twins", ["signal_id"]).select("signal_id", "stored_id", "counted")


def stream_coverage(stories: DataFrame, root: str, checkpoint: str, once: bool = False, seen=lambda weeks: None) -> StreamingQuery:
    """Story coverage over a stream: logs ``arrived``, ``told`` (first of their url and title) and ``verdicts`` (each story's leader).

    ``stories``: story_id, category, topic, title, url, ts_us.  Which stories are told first is streaming state; only titles whose
    first story lost its url to a late one are looked up in the log.  Verdicts are made anew from the earliest change of a category
    on, for as many weeks as they change (`story_state.elect`).
    """
    def each(batch: DataFrame, number: int) -> None:
        # What follows the state are plain jobs over files, for which the session of ``stories`` may adapt partitions and joins; that of a stream may not.
        spark = stories.sparkSession
        arrived = _write_buckets(spark, batch, f"{root}/arrived", number, "title")
        known = arrived.where("NOT beyond AND (told OR revoked)")
        # Of several rows of a story in one batch, the last word is that it is not told.
        told = known.groupBy("story_id").agg(F.min_by(F.struct(*story_state.NAMES[1:], "told"), "told").alias("r")).select("story_id", "r.*")
        titles = arrived.where("beyond").select("title", "bucket").distinct()
        buckets = _buckets(titles)
        if buckets:
            log = _log(spark, f"{root}/arrived", number, arrived.schema).where(F.col("bucket").isin(buckets))
            told = told.unionByName(story_state.told_from_log(log, titles.select("title")).select(*told.columns))
        _write_weeks(told.withColumn("week", story_state.week(F.col("ts_us"))), f"{root}/told", number)
        logs = {"told": f"{story_state.STORY}, told boolean, week long", "verdicts": "category string, story_id long, leader_id long, week long"}

        def read(name: str, weeks: list[int], upto: int = number) -> DataFrame:
            log = _log(spark, f"{root}/{name}", upto if name == "told" else number - 1, logs[name])
            return story_state.newest(log.where(F.col("week").isin(weeks)))

        new = spark.read.schema(logs["told"]).parquet(f"{root}/told/batch={number}")
        before = read("told", [r[0] for r in new.select("week").distinct().collect()], number - 1).select("story_id", F.col("told").alias("was"))
        changed = cut(new.join(before, "story_id", "left").where(F.col("told") != F.coalesce("was", F.lit(False))).select("category", "week", "ts_us", "story_id"))
        if changed.isEmpty():
            return
        found = story_state.elect(read, changed, seen)
        _write_weeks(found, f"{root}/verdicts", number)

    with _keyed_state(stories.sparkSession, once):
        return _start(story_state.flagged(stories), each, checkpoint, once)


def coverage_so_far(spark, root: str) -> DataFrame:
    """story_id and coverage of all stories that are told."""
    log = spark.read.option("basePath", f"{root}/verdicts").parquet(f"{root}/verdicts/batch=*")
    last = story_state.newest(log).where("leader_id IS NOT NULL")
    return last.groupBy(F.col("leader_id").alias("story_id")).agg(F.count("*").alias("coverage"))


# ---------------------------------------------------------------- windows
def stream_counts(events: DataFrame, ts: str, keys: list[str], root: str, checkpoint: str, size: str = "1 day", slide: str | None = None, once: bool = False) -> StreamingQuery:
    """Log each micro-batch's counts per window and key; sums of the log are complete at any time and take late rows."""
    def each(batch: DataFrame, number: int) -> None:
        w = F.window(ts, size, slide) if slide else F.window(ts, size)
        _write(batch.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select("w.start", "w.end", *keys, "n"), root, number)

    return _start(events, each, checkpoint, once)


def window_counts(spark, root: str, keys: list[str]) -> DataFrame:
    """Counts of all that has arrived: start, end, keys, n."""
    log = spark.read.option("basePath", root).parquet(f"{root}/batch=*")
    return log.groupBy("start", "end", *keys).agg(F.sum("n").alias("n"))


def late_items(items: DataFrame, as_of, days: int = fv.MAX_ITEM_AGE_DAYS) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): late dated items are dropped, undated ones kept."""
    kept = gates.age_gate(items, as_of, days)
    from ..functions.numeric import older_than

    return kept, items.where(older_than(F.col("published_at"), as_of, days))


# ---------------------------------------------------------------- acknowledgements
def current_checkpoint(acks: DataFrame) -> DataFrame:
    """The brief's checkpoint out of the log of acknowledgements and one-step undos.

    ``acks``: seq, action (``ack`` or ``undo``), at.  Undo returns to the acknowledgement before
    the last one; a second undo in a row changes nothing more.  Only the last two
    acknowledgements and the last action matter, which are plain aggregates.
    """
    last = acks.groupBy().agg(
        F.max_by("action", "seq").alias("action"),
        F.max(F.when(F.col("action") == "ack", F.struct("seq", "at"))).alias("a1"))
    prior = acks.where("action = 'ack'").orderBy(F.desc("seq")).limit(2).agg(F.min(F.struct("seq", "at")).alias("a2"), F.count("*").alias("n"))
    both = last.withColumn("_k", F.lit(1)).join(prior.withColumn("_k", F.lit(1)), "_k")
    start = F.timestamp_seconds(F.lit(0))
    back = F.when(F.col("n") >= 2, F.col("a2.at")).otherwise(start)
    return both.select(F.coalesce(F.when(F.col("action") == "undo", back).otherwise(F.col("a1.at")), start).alias("checkpoint"))
