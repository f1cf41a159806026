"""Ranked lists, briefs, queues and per-key picks.

Sorts end in the row id, so every list is totally ordered.  Limits compile to
TakeOrderedAndProject and per-key picks to a window group limit, both of which cut
rows before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_packs as fp
from ..functions import fixed_values as fv
from ..functions.numeric import age_days, round_half_up


def per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of every key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def newest_first_batch(items: DataFrame, n: int = 60) -> DataFrame:
    """Newest unprocessed items by published, else fetched date."""
    when = F.coalesce("published_at", "fetched_at")
    return items.where("status = 'new'").orderBy(when.desc(), F.desc("item_id")).limit(n)


# ---------------------------------------------------------------- brief
def brief_candidates(scored: DataFrame, checkpoint: Column, min_score: int = fv.BRIEF_MIN_SCORE, n: int = fv.BRIEF_CANDIDATES) -> DataFrame:
    fresh = scored.where((F.col("status") != "dismissed") & (F.col("last_event_at") > checkpoint) & (F.col("score") >= min_score))
    return fresh.orderBy(F.desc("score"), "company_id").limit(n)


def brief_topk(scored: DataFrame, checkpoint: Column, size: int = fv.BRIEF_SIZE, exploration: float = fv.BRIEF_EXPLORATION) -> DataFrame:
    """The brief: best companies, then the best of each sector not shown yet.

    The greedy exploration loop picks, in rank order, first the best company of each
    sector missing from the top, then the rest; that is one row number per sector and
    one sort over at most a few hundred candidates.
    """
    exploit = math.ceil(size * (1 - exploration))
    cands = brief_candidates(scored, checkpoint)
    ranked = cands.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "company_id")))
    in_sector = Window.partitionBy("sector").orderBy("rank")
    marked = ranked.withColumn("first_of_sector", F.row_number().over(in_sector) == 1)
    top = F.col("rank") <= exploit
    order = F.when(top, 0).when(F.col("first_of_sector"), 1).otherwise(2)
    picked = marked.withColumn("explore", ~top).orderBy(order, "rank").limit(size)
    return picked.withColumn("position", F.row_number().over(Window.orderBy(order, "rank"))).drop("first_of_sector")


def badge(first_seen: Column, last_event: Column, checkpoint: Column) -> Column:
    """``new`` or ``updated`` since the checkpoint."""
    return F.when(first_seen > checkpoint, "new").when(last_event > checkpoint, "updated")


def brief_badges(candidates: DataFrame, checkpoint: Column) -> DataFrame:
    b = candidates.withColumn("badge", badge(F.col("first_seen_at"), F.col("last_event_at"), checkpoint))
    return b.agg(F.count(F.when(F.col("badge") == "new", 1)).alias("total_new"),
                 F.count(F.when(F.col("first_seen_at") <= checkpoint, 1)).alias("total_updated"))


def brief_intel(intel: DataFrame, checkpoint: Column, n: int = 8) -> DataFrame:
    """Most important stories since the checkpoint."""
    fresh = intel.where((F.col("created_at") > checkpoint) & (F.col("category") != "voice"))
    return fresh.orderBy(F.desc("importance"), F.desc_nulls_last("published_at"), "intel_id").limit(n)


def hot_posts(intel: DataFrame, checkpoint: Column, score: int = 80) -> DataFrame:
    hot = (F.col("category") == "voice") & (F.col("status") == "new") & (F.col("score") >= score) & (F.col("created_at") > checkpoint)
    return intel.agg(F.count(F.when(hot, 1)).alias("hot"))


# ---------------------------------------------------------------- search
ORDERS = {
    "score": lambda: [F.desc("score"), F.desc("last_event_at")], "recent": lambda: [F.desc("last_event_at")],
    "new": lambda: [F.desc("first_seen_at")], "name": lambda: [F.lower("name").asc()],
}


def having_signal(companies: DataFrame, signals: DataFrame, column: str, value) -> DataFrame:
    """Companies with at least one signal of that value: a left-semi join."""
    return companies.join(signals.where(F.col(column) == value).select("company_id"), "company_id", "left_semi")


def lead_search(companies: DataFrame, signals: DataFrame, as_of: Column, status: str | None = None, q: str | None = None,
                sector: str | None = None, min_score: int | None = None, stage: str | None = None, source: str | None = None,
                type: str | None = None, intl: bool = False, days: float | None = None, hide_enterprise: bool = False) -> DataFrame:
    """All filters combine; dismissed companies are hidden unless asked for."""
    c = companies
    if status and status != "all":
        c = c.where(F.col("status") == status)
    elif status != "all":
        c = c.where(F.col("status") != "dismissed")
    if q:
        # LIKE in the caller's words: % and _ keep their meaning.
        like = [F.coalesce(F.col(x).ilike(f"%{q}%"), F.lit(False)) for x in ("name", "description", "why", "city")]
        c = c.where(like[0] | like[1] | like[2] | like[3])
    if sector:
        c = c.where(F.col("sector") == sector)
    if min_score:
        c = c.where(F.col("score") >= min_score)
    if intl:
        c = c.where(F.col("sells_intl").isin("yes", "likely") | (F.size("markets") > 0))
    if days:
        c = c.where(age_days(F.col("last_event_at"), as_of) < days)
    if hide_enterprise:
        c = c.where(F.col("size") != "enterprise")
    for column, value in (("stage", stage), ("source_id", source), ("type", type)):
        if value:
            c = having_signal(c, signals, column, value)
    return c


def page(rows: DataFrame, sort: str = "score", limit: int = 50, offset: int = 0) -> DataFrame:
    order = ORDERS.get(sort, ORDERS["score"])()
    return rows.orderBy(*order, "company_id").offset(offset).limit(min(200, limit))


# ---------------------------------------------------------------- company views
def latest_event(signals: DataFrame) -> DataFrame:
    cols = F.struct("signal_id", "type", "title", "url", "source_id", "occurred_at")
    return signals.groupBy("company_id").agg(F.max_by(cols, F.struct("occurred_at", -F.col("signal_id"))).alias("latest"))


def latest_funding(signals: DataFrame) -> DataFrame:
    """Newest funding event; a directory entry only when there is none."""
    cols = F.struct("signal_id", "type", "stage", "amount_usd_m", "occurred_at")
    order = F.struct((F.col("type") == "funding").cast("int").alias("f"), F.col("occurred_at").alias("at"), (-F.col("signal_id")).alias("id"))
    fund = signals.where(F.col("type").isin("funding", "directory"))
    return fund.groupBy("company_id").agg(F.max_by(cols, order).alias("funding"))


def top_signals(signals: DataFrame, n: int = 6) -> DataFrame:
    """First ``n`` distinct tags over a company's events, newest event first."""
    from .merge import first_distinct

    spread = signals.select("company_id", "occurred_at", "signal_id", F.posexplode("tags").alias("pos", "tag"))
    spread = spread.select("company_id", "tag", F.struct((-F.unix_micros("occurred_at")).alias("t"), "signal_id", "pos").alias("at"))
    return first_distinct(spread, "company_id", "tag", "at", n, "signals")


def lead_view(companies: DataFrame, signals: DataFrame, contacts: DataFrame | None = None) -> DataFrame:
    """One wide row per company; the signals aggregate once, no per-row lookups."""
    sources = signals.groupBy("company_id", "source_id").agg(F.count("*").alias("n")).groupBy("company_id").agg(
        F.array_sort(F.collect_list("source_id")).alias("sources"))
    totals = signals.groupBy("company_id").agg(
        F.count("*").alias("event_count"), F.sum(F.coalesce("corroborations", F.lit(1))).alias("corroborations"),
        F.max("occurred_at").alias("last_event_at"))
    v = companies
    for part in (latest_funding(signals), latest_event(signals), top_signals(signals), sources, totals):
        v = v.join(part, "company_id", "left")
    if contacts is not None:
        people = contacts.groupBy("company_id").agg(F.count(F.when(~F.col("do_not_contact"), 1)).alias("people_count"))
        v = v.join(people, "company_id", "left").withColumn("people_count", F.coalesce("people_count", F.lit(0)))
    return v.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("event_count", "corroborations")})


def events_with_source(signals: DataFrame, sources: DataFrame) -> DataFrame:
    """Events with the source's name, or its id when unknown."""
    s = sources.select("source_id", F.col("name").alias("source_name"))
    return signals.join(s, "source_id", "left").withColumn("source_name", F.coalesce("source_name", "source_id"))


# ---------------------------------------------------------------- queues
def enrich_queue(companies: DataFrame, min_score: int = fv.ENRICH_MIN_SCORE, n: int = fv.ENRICH_PER_CYCLE) -> DataFrame:
    due = ~F.col("enriched") | F.col("people_checked_at").isNull()
    ok = due & (F.col("status") != "dismissed") & (F.col("score") >= min_score) & (F.col("size") != "enterprise")
    return companies.where(ok).orderBy(F.desc("score"), "company_id").limit(n)


def lookup_queue(companies: DataFrame, plans: DataFrame, contacts: DataFrame, min_score: int) -> DataFrame:
    """Primary contacts of good companies whose e-mail was never looked up."""
    good = companies.where(F.col("score") >= min_score).select("company_id", "score")
    primary = good.join(plans.where(F.col("primary_id").isNotNull()).select("company_id", "primary_id"), "company_id")
    open_ = contacts.where(F.col("email").isNull() & F.col("email_checked_at").isNull()).select(F.col("contact_id").alias("primary_id"), "name")
    return primary.join(open_, "primary_id")


def feedback_examples(companies: DataFrame, n: int = 5) -> DataFrame:
    rated = companies.where(F.col("feedback") != 0)
    return per_key(rated, ["feedback"], [F.desc("updated_at"), F.col("company_id").asc()], n)


def stale_payloads(payloads: DataFrame, as_of: Column, days: float, miss_days: float) -> DataFrame:
    """Adds ``stale``: payloads (and remembered misses) older than their shelf life."""
    limit = F.when(F.col("found"), F.lit(float(days))).otherwise(F.lit(float(miss_days)))
    return payloads.withColumn("stale", F.coalesce(age_days(F.col("fetched_at"), as_of) > limit, F.lit(True)))


def due_sources(sources: DataFrame, as_of: Column) -> DataFrame:
    """Enabled sources that are due, never-run first."""
    due = sources.where(F.col("enabled") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= as_of)))
    return due.orderBy(F.asc_nulls_first("next_run_at"), "source_id")


def source_listing(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.desc("enabled"), (F.col("created_by") == "agent").asc(), "category", "name", "source_id")


def run_log(runs: DataFrame, sources: DataFrame, n: int = 100) -> DataFrame:
    last = runs.orderBy(F.desc("run_id")).limit(n)
    return last.join(sources.select("source_id", "name"), "source_id", "left")


# ---------------------------------------------------------------- search rotation
def segment_grid(segments: Iterable[str], spark, intents: Iterable[str], template: str = "India {s} {i}") -> DataFrame:
    """All segment x intent queries, generated from two literal lists."""
    base = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in segments])).alias("segment"))
    return grid_of(base, intents, template)


def grid_of(segments: DataFrame, intents: Iterable[str], template: str = "India {s} {i}") -> DataFrame:
    """Every row's segment with every intent: a generator, not a cross join."""
    g = segments.select("segment", F.explode(F.array(*[F.lit(i) for i in intents])).alias("intent"))
    a, rest = template.split("{s}")
    b, c = rest.split("{i}")
    return g.withColumn("query", F.concat(F.lit(a), "segment", F.lit(b), "intent", F.lit(c)))


def rotate_queries(grid: DataFrame, used: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` unused queries in a seeded order; used ones come back once fewer than ``n`` are left."""
    marked = grid.join(used.select("query", F.lit(1).alias("was_used")).distinct(), "query", "left")
    fresh = F.col("was_used").isNull()
    return marked.orderBy(F.when(fresh, 0).otherwise(1), F.md5(F.concat(F.lit(f"{seed}|"), "query")), "query").limit(n).select("query", "segment", "intent")


def coverage_gap(companies: DataFrame) -> DataFrame:
    return companies.groupBy("sector").agg(F.count("*").alias("n")).orderBy("n", "sector")


def lookalike_queries(companies: DataFrame, segments: dict | None = None, region: str = "Indian") -> DataFrame:
    """Two search strings per company out of its sector and first two concrete markets."""
    seg = None
    for k, v in (segments or fp.LOOKALIKE_SEGMENTS).items():
        seg = F.when(F.col("sector") == k, v) if seg is None else seg.when(F.col("sector") == k, v)
    seg = seg.otherwise(fp.LOOKALIKE_DEFAULT)
    two = F.slice(F.filter("markets", lambda m: m != fp.GLOBAL_MARKET), 1, 2)
    where = F.when(F.size(two) > 0, F.concat(F.lit("expands "), F.array_join(two, " OR "))).otherwise("international expansion")
    q = F.array(F.concat(F.lit(region + " "), seg, F.lit(" "), where, F.lit(" when:30d")),
                F.concat(F.lit(region + " "), seg, F.lit(" raises funding global customers when:30d")))
    return companies.select("company_id", F.explode(q).alias("query"))


def retire_queries(sources: DataFrame, as_of: Column) -> DataFrame:
    """Expired automatic queries: extend once when they produced leads, else disable.  Adds ``action``."""
    expired = sources.where((F.col("created_by") == "agent") & F.col("enabled") & (F.col("expires_at") < as_of))
    return expired.withColumn("action", F.when((F.col("leads_total") > 0) & ~F.col("extended"), "extend").otherwise("disable"))


def tune_cadence(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """New cadence out of the mean yield of the last four good runs (three needed)."""
    last = per_key(runs.where("status = 'ok'"), ["source_id"], [F.desc("run_id")], 4)
    mean = last.groupBy("source_id").agg(F.avg("new_items").alias("mean"), F.count("*").alias("n")).where("n >= 3")
    cad = F.col("cadence_min")
    new = F.when(F.col("mean") == 0, F.least(F.col("max_cadence"), round_half_up(cad * 1.5))).when(
        F.col("mean") >= 8, F.greatest(F.col("min_cadence"), round_half_up(cad * 0.75))).otherwise(cad)
    return sources.where("enabled").join(mean, "source_id").withColumn("cadence_new", new.cast("int")).drop("mean", "n")
