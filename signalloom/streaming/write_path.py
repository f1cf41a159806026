"""From passed items to scored companies: what a batch of mentions changes, and nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import norm_name
from ..operators import merge, score, twins
from ..operators.extract import headline_leads
from ..operators.gates import min_confidence
from ..operators.state import cut
from ..sources.store import Store

#: The tables of one state, in the order in which they are written.
TABLES = ["mentions", "companies", "signals", "scores"]


def mentions_of(items: DataFrame) -> DataFrame:
    """Mentions of companies in items (item_id, title, summary, url, published_us), each with its company's id.

    A company is known by its name in normal form, so the id does not depend on what was stored before.
    """
    return known_by_name(min_confidence(headline_leads(items.select("item_id", "title", "summary", "url", "published_us"))))


def known_by_name(found: DataFrame) -> DataFrame:
    """Mentions of `headline_leads`, each with its company's id."""
    return found.drop("team").withColumn("company_id", F.xxhash64(norm_name(F.col("name"))))


def companies_of(mentions: DataFrame) -> DataFrame:
    """Companies out of all their mentions, in the order of item_id."""
    text = F.lit(None).cast("string")
    rows = mentions.withColumns({"ord": F.col("item_id"), "domain": text, "logo": text})
    base = merge.merge_company(rows)
    more = mentions.groupBy("company_id").agg(F.bool_or("in_region").alias("in_region"), F.timestamp_micros(F.min("published_us")).alias("first_seen_at"))
    return base.join(more, "company_id")


def signals_of(mentions: DataFrame) -> DataFrame:
    """Stored events of companies with their corroborations: every mention is an event, repeats are folded into the first."""
    events = mentions.select(
        F.col("item_id").alias("signal_id"), "company_id", "type", "title", "url", "stage", "amount_usd_m", "confidence", F.col("signals").alias("tags"), "investors",
        F.col("published_us").alias("occurred_us"))
    stored = twins.corroborate(events, twins.event_twins(events))
    own = mentions.select(F.col("item_id").alias("stored_id"), "summary", "competitors")
    return stored.join(own, "stored_id").withColumnRenamed("stored_id", "signal_id").withColumn("occurred_at", F.timestamp_micros("occurred_us"))


def scores_of(companies: DataFrame, signals: DataFrame, as_of: Column, cfg: score.ScoreConfig | None = None) -> DataFrame:
    """Scores of companies whose site was not looked at yet."""
    none = F.array().cast("array<string>")
    facts = companies.withColumns({"enriched": F.lit(False), "providers": none, "currencies": none, "ships_abroad": F.lit(False), "locales": F.lit(0)})
    return score.score_company(facts, signals, as_of, cfg).select("company_id", "name", "score", "breakdown")


def apply_batch(store: Store, mentions: DataFrame, version: int, as_of: Column, cfg: score.ScoreConfig | None = None) -> None:
    """Add the mentions of a batch and derive its companies, their signals and scores anew, then make all of it visible at once.

    ``mentions``: those of the batch, as `mentions_of` gives them.
    Only companies that the batch mentions are derived, from their buckets of the mentions.
    """
    new = store.write("mentions", mentions, version)
    touched = new.select("company_id", "bucket").distinct()
    buckets = [r[0] for r in touched.select("bucket").distinct().collect()]  # one number per bucket at most
    schema = T.StructType([f for f in new.schema.fields if f.name != "bucket"])
    # This version's own mentions are not visible yet, but they count; an item that comes again replaces its mention.
    log = store.log("mentions", schema, upto=version, buckets=buckets).drop("bucket")
    rest = [f.name for f in schema.fields if f.name != "item_id"]
    known = log.groupBy("item_id").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("item_id", "r.*")
    mentions = cut(known.join(touched.select("company_id"), "company_id", "left_semi"))
    companies = store.write("companies", companies_of(mentions), version)
    signals = store.write("signals", signals_of(mentions), version)
    store.write("scores", scores_of(companies.drop("bucket"), signals.drop("bucket"), as_of, cfg), version)
    store.commit(version, TABLES)


def recomputed(items: DataFrame, as_of: Column, cfg: score.ScoreConfig | None = None) -> dict[str, DataFrame]:
    """All tables of the state out of all items at once, which is what the batches must add up to."""
    mentions = cut(mentions_of(items))
    companies, signals = companies_of(mentions), signals_of(mentions)
    return {"mentions": mentions, "companies": companies, "signals": signals, "scores": scores_of(companies, signals, as_of, cfg)}
