"""Story classifier: which items belong in the intel feed, filed under what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_packs as fp
from ..functions import fixed_values as fv
from ..functions.packs import RulePack, Topic, TopicPack
from ..functions.regex import extract, matches, phrases
from .gates import item_text

DEFAULT_TOPICS = TopicPack(tuple(Topic(*t) for t in fp.TOPICS))
ACTIONS = RulePack.of(fp.COMPETITOR_ACTIONS)


def competitor_action(title: Column) -> Column:
    """What a competitor headline is about: launch, capital, licence, pricing or other."""
    return ACTIONS.first(title, "other")


def _row(category, importance, topic, advice) -> Column:
    col = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(
        col(category, "string").alias("category"), col(importance, "int").alias("importance"),
        col(topic, "string").alias("topic"), col(advice, "string").alias("advice"),
    )


def classify_intel(
    items: DataFrame,
    topics: TopicPack = DEFAULT_TOPICS,
    competitors: list[str] | None = None,
    own_brand: str | None = None,
    own_brand_except: str | None = None,
    region: str = fp.INTEL_REGION,
    noise: list[str] | None = None,
    keep_all: bool = False,
    only: Column | None = None,
) -> DataFrame:
    """Adds ``verdict`` struct(category, importance, topic, advice) and drops items without one.

    ``keep_all`` keeps them with a null verdict, and so it does with items that are not ``only``'s, which are not judged.

    Order: own brand, noise (title; also body for regulator sources), import-only
    stories, competitors in action, region gate (regulators exempt), first topic
    on the title alone.
    """
    title = F.coalesce(F.col("title"), F.lit(""))
    text = item_text(title, F.col("summary"))
    regulator = F.col("source_id").rlike(fp.REGULATOR_SOURCES)
    noise_re = "|".join(f"(?:{n})" for n in (noise or fp.INTEL_NOISE))
    noisy = (matches(title, noise_re) | (regulator & matches(text, noise_re))) & ~matches(title, fp.INTEL_NOISE_EXCEPT)
    import_only = matches(title, fp.IMPORT_ONLY) & ~matches(text, fp.IMPORT_EXCEPT)
    names = competitors or fv.COMPETITORS
    competitor = matches(title, phrases(names)) & matches(title, fp.COMPETITOR_STORY)
    drop = F.lit(None).cast("struct<category:string,importance:int,topic:string,advice:string>")
    chain = F.when(F.lit(False) if only is None else ~F.coalesce(only, F.lit(False)), drop)
    if own_brand:
        mine = matches(title, phrases([own_brand]))
        if own_brand_except:
            chain = chain.when(mine & matches(title, own_brand_except), drop)
        chain = chain.when(mine, _row("own", 2, "own", "Own brand in the news: share and reuse."))
    advice = F.concat(extract(title, phrases(names)), F.lit(": "), competitor_action(title))
    v = topics.verdict(title)
    chain = (
        chain.when(noisy, drop).when(import_only, drop)
        .when(competitor, _row("competitor", 2, "competitor", advice))
        .when(~regulator & ~matches(text, region), drop)
        .when(v.isNotNull(), _row(v["category"], v["importance"], v["topic"], v["advice"]))
    )
    if keep_all:
        return items.withColumn("verdict", chain)
    # A generator evaluates the chain once; a filter would repeat it for the test and the output.
    return items.select("*", F.explode(F.array_compact(F.array(chain))).alias("verdict"))


def rebuild_intel(items: DataFrame, status_log: DataFrame, key: str, **rules) -> DataFrame:
    """Judge every stored item again after a rules change; the newest triage status by key survives.

    ``status_log``: key, seq, status; of several entries of a key the one with the highest ``seq`` counts.
    """
    judged = classify_intel(items, **rules)
    newest = status_log.groupBy(key).agg(F.max_by("status", "seq").alias("status"))
    return judged.join(newest, key, "left").withColumn("status", F.coalesce("status", F.lit("new")))
