"""Set-wise merges: what one-by-one updates leave behind, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fv
from ..functions.numeric import lookup
from .fold import clamped_sum


def first_known(value: Column, order: Column) -> Column:
    """First non-null value in order (an aggregate)."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def first_distinct(rows: DataFrame, key: str, value: str, order: str, n: int | None, name: str) -> DataFrame:
    """Per key the first ``n`` distinct values in order of first appearance.

    Values combine before the shuffle, and only ``n`` rows per key are gathered.
    """
    seen = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_at"))
    if n is not None:
        w = Window.partitionBy(key).orderBy("_at", value)
        seen = seen.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    packed = seen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("v")))).alias("a"))
    return packed.select(key, F.transform("a", lambda x: x["v"]).alias(name))


def _rank(sells: Column) -> Column:
    return F.coalesce(lookup(sells, fv.SELLS_ABROAD_RANK), F.lit(1))


def merge_company(mentions: DataFrame) -> DataFrame:
    """One company row out of its mentions in arrival order.

    ``mentions``: company_id, ord, name, domain, website, logo, city, description, sector,
    size, sells_intl, markets, confidence.  The first known value wins; a sector
    stands once it is not ``Other``, a size once it is not ``unknown``, and the
    strongest statement about selling abroad wins.
    """
    o = F.col("ord")
    first = lambda c: first_known(F.col(c), o).alias(c)
    sector = F.when(F.col("sector") != "Other", F.col("sector"))
    size = F.when(F.col("size") != "unknown", F.col("size"))
    base = mentions.groupBy("company_id").agg(
        first("name"), first("domain"), first("website"), first("logo"), first("city"), first("description"),
        F.coalesce(first_known(sector, o), F.lit("Other")).alias("sector"),
        F.coalesce(first_known(size, o), F.lit("unknown")).alias("size"),
        F.max_by(F.coalesce("sells_intl", F.lit("unknown")), _rank(F.col("sells_intl"))).alias("sells_intl"),
        F.max(F.coalesce("confidence", F.lit(0.5))).alias("confidence"),
    )
    aliases = first_distinct(mentions, "company_id", "name", "ord", 10, "aliases")
    spread = mentions.select("company_id", "ord", F.posexplode("markets").alias("pos", "market"))
    spread = spread.select("company_id", "market", F.struct("ord", "pos").alias("at"))
    markets = first_distinct(spread, "company_id", "market", "at", None, "markets")
    none = F.array().cast("array<string>")
    return base.join(aliases, "company_id", "left").join(markets, "company_id", "left").withColumn(
        "markets", F.coalesce("markets", none))


def pain_events(mentions: DataFrame) -> DataFrame:
    """New events plus one ``pain`` event for each that quotes payment friction."""
    pain = mentions.where(F.col("payment_pain").isNotNull()).withColumn("type", F.lit("pain")).withColumn(
        "title", F.lit("Payment friction mentioned")).withColumn("summary", F.col("payment_pain"))
    return mentions.unionByName(pain).drop("payment_pain")


def best_team_size(readings: DataFrame) -> DataFrame:
    """Per company the reading of the most trusted source; of equals the newest."""
    rank = F.coalesce(lookup(F.col("source"), fv.TEAM_SOURCE_RANK), F.lit(0))
    rest = [c for c in readings.columns if c != "company_id"]
    best = readings.groupBy("company_id").agg(F.max_by(F.struct(*rest), F.struct(rank, "seq")).alias("r"))
    return best.select("company_id", "r.*")


def merge_enrichment(companies: DataFrame, sites: DataFrame) -> DataFrame:
    """Fill url, description and domain from a site check; sharpen sells_intl only while open."""
    s = sites.select(
        "company_id", *[F.col(c).alias(f"site_{c}") for c in ("url", "description", "domain", "sells_intl")])
    open_ = F.col("sells_intl").isin("unknown", "likely")
    return companies.join(s, "company_id", "left").withColumn("website", F.coalesce("site_url", "website")).withColumn(
        "description", F.coalesce("description", "site_description")
    ).withColumn("domain", F.coalesce("site_domain", "domain")).withColumn(
        "sells_intl", F.when(F.col("site_sells_intl").isNotNull() & open_, F.col("site_sells_intl")).otherwise(F.col("sells_intl"))
    ).drop("site_url", "site_description", "site_domain", "site_sells_intl")


def domain_conflict(found: DataFrame, companies: DataFrame) -> DataFrame:
    """Discovered domains that no other company holds.

    ``found``: company_id, domain.  An aggregate of owners per domain keeps the
    join at one row per domain.
    """
    owners = companies.where(F.col("domain").isNotNull()).groupBy("domain").agg(
        F.min("company_id").alias("_lo"), F.max("company_id").alias("_hi"))
    j = found.join(owners, "domain", "left")
    own = F.col("_lo").isNull() | ((F.col("_lo") == F.col("company_id")) & (F.col("_hi") == F.col("company_id")))
    return j.where(own).drop("_lo", "_hi")


def fold_feedback(votes: DataFrame, step: float = fv.LEARN_STEP, bound: float = fv.LEARN_BOUND) -> DataFrame:
    """Learned weight per sector: each vote change moves it, clamped at every step."""
    moves = votes.select("sector", "seq", ((F.col("next") - F.col("prev")) * F.lit(step)).alias("delta"))
    return clamped_sum(moves, ["sector"], "seq", "delta", -bound, bound).withColumnRenamed("value", "weight")


def feedback_counters(votes: DataFrame) -> DataFrame:
    """Approvals and rejections per source, never below zero at any step."""
    def one(flag: str, vote: int) -> DataFrame:
        move = (F.col("next") == vote).cast("int") - (F.col("prev") == vote).cast("int")
        steps = votes.select("source_id", "seq", move.alias("delta"))
        return clamped_sum(steps, ["source_id"], "seq", "delta", 0.0, float("inf")).select(
            "source_id", F.col("value").cast("bigint").alias(flag))

    return one("approved", 1).join(one("rejected", -1), "source_id", "full")


def source_quality(counters: DataFrame) -> DataFrame:
    """Approved share in percent, null when nobody voted."""
    total = F.col("approved") + F.col("rejected")
    return counters.withColumn(
        "quality", F.when(total > 0, F.floor(F.col("approved") / total * 100 + F.lit(0.5)).cast("bigint")))


def latest_wins(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Upsert: the last log row per key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def cascade_delete(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of the parents that are left; those of deleted parents, and those without one, go."""
    return children.join(parents.select(key), key, "left_semi")
