"""Counts, facets, funnels and periodic reports: one pass each, conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.numeric import age_days, round_half_up
from .voice import band_of


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def kpi_counts(companies: DataFrame, signals: DataFrame, items: DataFrame, intel: DataFrame, sources: DataFrame,
               as_of: Column, threshold: int = fv.THRESHOLD) -> DataFrame:
    """The scalar counters of the front page: one aggregate per table, one row in all."""
    within = lambda c, d: F.coalesce((age_days(F.col(c), as_of) < d), F.lit(False))
    live = F.col("status") != "dismissed"
    parts = [
        companies.agg(_n(live).alias("companies"), _n(live & (F.col("score") >= threshold)).alias("high_intent"),
                      _n(within("first_seen_at", 1)).alias("new_today"), _n(live & F.col("sells_intl").isin("yes", "likely")).alias("intl_signals")),
        signals.agg(_n(within("created_at", 1)).alias("events_24h"),
                    F.countDistinct(F.when((F.col("type") == "funding") & within("occurred_at", 30), F.col("company_id"))).alias("funding_signals")),
        intel.agg(_n(within("created_at", 1)).alias("intel_24h")),
        items.agg(_n(within("fetched_at", 1)).alias("items_24h"), F.count("*").alias("items_total"),
                  _n(F.col("status").isin("done", "processing")).alias("passed_total"), _n(F.col("status").isin("filtered", "dup")).alias("filtered_total"),
                  _n(F.col("status").isin("new", "processing")).alias("queue")),
        sources.agg(_n(F.col("enabled")).alias("sources_active"), _n(F.col("enabled") & (F.col("last_status") == "error")).alias("sources_error"),
                    _n(F.col("enabled") & (F.col("created_by") == "agent")).alias("agent_queries")),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def funnel(counts: DataFrame) -> DataFrame:
    """Stages of the funnel as rows."""
    stages = [("read", "items_total"), ("passed", "passed_total"), ("companies", "companies"), ("high intent", "high_intent"), ("sources live", "sources_active")]
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(a).alias("stage"), F.col(b).alias("n")) for i, (a, b) in enumerate(stages)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def sector_stats(companies: DataFrame) -> DataFrame:
    s = companies.where("status <> 'dismissed'").groupBy("sector").agg(F.count("*").alias("n"), round_half_up(F.avg("score")).alias("avg_score"))
    return s.orderBy(F.desc("n"), "sector")


def _labelled(name: str):
    """Array element -> (facet, value) pair."""
    return lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value"))


def facet_counts(rows: DataFrame, facets: dict[str, Column]) -> DataFrame:
    """(facet, value, n) for scalar and array facets in one pass over the rows."""
    entries = []
    for name, col in facets.items():
        entries.append(F.transform(F.coalesce(col, F.array().cast("array<string>")), _labelled(name)))
    return rows.select(F.explode(F.concat(*entries)).alias("e")).where("e.value IS NOT NULL").groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))


def as_facet(col: Column) -> Column:
    return F.array_compact(F.array(col))


def cross_filter_facets(rows: DataFrame, filters: dict[str, Column], values: dict[str, Column], others: Column | None = None) -> DataFrame:
    """Counts of each facet's values under every filter except its own.

    ``filters``: facet -> predicate; ``values``: facet -> array of values; ``others``:
    predicate of filters without a facet (search text).  One scan, one aggregate.
    """
    base = F.lit(True) if others is None else others
    entries = []
    for name, vals in values.items():
        ok = base
        for other, pred in filters.items():
            if other != name:
                ok = ok & pred
        entry = F.transform(vals, _labelled(name))
        entries.append(F.when(ok, entry).otherwise(F.array().cast("array<struct<facet:string,value:string>>")))
    return rows.select(F.explode(F.concat(*entries)).alias("e")).groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))


def voice_report(posts: DataFrame, as_of: Column, days: float = 7) -> DataFrame:
    """Trailing report as (section, key, n): bands, intents, segments, fit, providers, complaints, restricted."""
    recent = posts.where(age_days(F.coalesce("published_at", "created_at"), as_of) < days)
    none = F.array().cast("array<string>")
    return facet_counts(recent, {
        "total": F.array(F.lit("posts")),
        "band": F.array(band_of(F.coalesce("score", F.lit(0)))), "intent": F.col("intents"), "segment": as_facet(F.col("segment")),
        "fit": as_facet(F.col("fit")), "provider": F.col("providers"),
        "complaint": F.when(F.col("unhappy"), F.col("providers")).otherwise(none),
        "restricted": F.when(F.col("restricted").isNotNull(), F.array(F.lit("posts"))).otherwise(none),
    })


def channel_yield(posts: DataFrame, as_of: Column, days: float = 7, n: int = 12) -> DataFrame:
    """Per channel (combined ones split on ``+``): posts, high, replied, lead; best ``n``."""
    recent = posts.where(age_days(F.coalesce("published_at", "created_at"), as_of) < days)
    one = recent.select(F.explode(F.split(F.coalesce("channel", F.lit("search")), r"\+")).alias("channel"), "score", "status")
    agg = one.groupBy("channel").agg(
        F.count("*").alias("posts"), _n(F.coalesce("score", F.lit(0)) >= 80).alias("high"), _n(F.col("status") == "replied").alias("replied"),
        _n(F.col("status") == "lead").alias("lead"))
    return agg.orderBy(F.desc("lead"), F.desc("high"), F.desc("posts"), "channel").limit(n)


def topic_counts(intel: DataFrame, as_of: Column, days: float | None = 30, q: str | None = None, min_importance: int | None = None, category: str | None = None) -> DataFrame:
    rows = intel
    if days:
        rows = rows.where(age_days(F.coalesce("published_at", "created_at"), as_of) <= days)
    if min_importance:
        rows = rows.where(F.col("importance") >= min_importance)
    if q:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "title", "advice")), F.lit(q.lower())))
    if category:
        rows = rows.where(F.col("category") == category)
    return rows.where("topic IS NOT NULL").groupBy("topic").agg(F.count("*").alias("n"))


def day_bucket(ts: Column, as_of: Column) -> Column:
    days = F.datediff(F.to_date(as_of), F.to_date(ts))
    return F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days < 7, "Earlier this week").when(days < 30, "Earlier this month").otherwise("Older")


def voice_inbox(posts: DataFrame, status: str = "open", band: str | None = None, segment: str | None = None, intent: str | None = None, n: int = 300) -> DataFrame:
    """Triage list: newest ``n`` of the filter, then by band and date."""
    rows = posts
    if status == "open":
        rows = rows.where("status = 'new'")
    elif status != "all":
        rows = rows.where(F.col("status") == status)
    if band:
        rows = rows.where(band_of(F.coalesce("score", F.lit(0))) == band)
    if segment:
        rows = rows.where(F.col("segment") == segment)
    if intent:
        rows = rows.where(F.array_contains("intents", intent))
    rows = rows.orderBy(F.desc_nulls_last(F.coalesce("published_at", "created_at")), "post_id").limit(n)
    rank = F.when(F.col("score") >= 80, 0).when(F.col("score") >= 50, 1).otherwise(2)
    return rows.orderBy(rank, F.desc_nulls_last(F.coalesce("published_at", "created_at")), "post_id")


def intel_feed(intel: DataFrame, sources: DataFrame, category: str | None = None, n: int = 150) -> DataFrame:
    rows = intel.where(F.col("category") != "voice")
    if category and category != "voice":
        rows = rows.where(F.col("category") == category)
    top = rows.orderBy(F.desc_nulls_last(F.coalesce("published_at", "created_at")), "intel_id").limit(n)
    return top.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id", "left")


def source_yield(items: DataFrame, first_mentions: DataFrame) -> DataFrame:
    """Items, passed items and new companies per source."""
    a = items.groupBy("source_id").agg(F.count("*").alias("items"), _n(F.col("status").isin("done", "processing")).alias("passed"))
    b = first_mentions.groupBy("source_id").agg(F.count("*").alias("leads"))
    return a.join(b, "source_id", "left").withColumn("leads", F.coalesce("leads", F.lit(0)))


def extraction_mix(items: DataFrame) -> DataFrame:
    return items.groupBy("via").agg(F.count("*").alias("n"))


def usage_ledger(calls: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Calls and cost per day and kind, with a flag where the day's cap is reached."""
    return _capped(calls, F.to_date("at").alias("day"), caps)


def usage_by_month(calls: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Calls and cost per month and kind, with a flag where the month's cap is reached."""
    return _capped(calls, F.date_format("at", "yyyy-MM").alias("month"), caps)


def _capped(calls: DataFrame, period: Column, caps: dict[str, int]) -> DataFrame:
    used = calls.groupBy(period, "kind").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))
    cap = F.lit(None).cast("int")
    for k, v in caps.items():
        cap = F.when(F.col("kind") == k, v).otherwise(cap)
    return used.withColumn("over_cap", F.coalesce(F.col("calls") >= cap, F.lit(False)))


def legacy_score(leads: DataFrame, weights: dict[str, int], sectors: list[str], stack_words: str = "payment|multi-currency|checkout") -> DataFrame:
    """The older additive model: presence flags times weights, clamped to 0..100."""
    w = lambda k, cond: F.when(F.coalesce(cond, F.lit(False)), weights.get(k, 0)).otherwise(0)
    some = F.size("signals") > 0
    total = (
        w("funding", F.col("funding").isNotNull()) + w("international", some) + w("sector", F.col("sector").isin(*sectors))
        + w("paymentPage", F.exists("signals", lambda s: s.rlike(f"(?i){stack_words}"))) + w("competitor", F.col("competitor").isNotNull())
    )
    return leads.withColumn("score", F.least(F.lit(100), F.greatest(F.lit(0), total)))


def legacy_kpis(scored: DataFrame, threshold: int) -> DataFrame:
    return scored.agg(
        _n(F.col("score") >= threshold).alias("qualified"), round_half_up(F.coalesce(F.avg("score"), F.lit(0.0))).alias("avg_score"),
        _n(F.col("funding").isNotNull()).alias("funded"), _n(F.size("signals") > 0).alias("international"))
