"""Posts: gate, tags and the 100-point intent score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_packs as fp
from ..functions import fixed_values as fv
from ..functions.numeric import clamp, older_than
from ..functions.packs import RulePack
from ..functions.regex import ascii_regex, edged, extract, matches, words
from .gates import item_text
from .state import once

INTENTS = RulePack.of(fp.POST_INTENTS)
SEGMENTS = RulePack.of(fp.POST_SEGMENTS)


def band_of(score: Column) -> Column:
    """Label of the score range."""
    (hi, a), (mid, b), (_, c) = fv.VOICE_BANDS
    return F.when(score >= hi, a).when(score >= mid, b).otherwise(c)


def focus_text(title: Column, text: Column, core: str = fp.POST_CORE) -> Column:
    """The title and the sentences that mention the core subject."""
    sentences = F.split(text, r"(?<=[.?!])\s+|\n+")
    about = edged(text, lambda p: F.filter(sentences, lambda s: s.rlike("(?i)" + p)), core)
    return F.concat_ws(" ", title, F.array_join(about, " "))


def core_hits(text: Column, core: str = fp.POST_CORE) -> Column:
    return edged(text, lambda p: F.regexp_count(text, F.lit("(?i)" + p)), core)


def voice_gate(posts: DataFrame, core: str = fp.POST_CORE, region: str = fp.POST_REGION,
               channels: str = fp.POST_REGION_CHANNELS) -> DataFrame:
    """Adds ``focus``, ``receive``, ``business`` and ``voice_pass``.

    Needs title, body, channel, comment.
    """
    title = F.coalesce(F.col("title"), F.lit(""))
    text = item_text(title, F.col("body"))
    df = once(once(posts, text=text), focus=focus_text(title, F.col("text"), core))
    text, focus = F.col("text"), F.col("focus")
    df = once(df, receive=matches(focus, fp.POST_RECEIVE) & ~matches(text, fp.POST_NO_RECEIVE), business=matches(text, fp.POST_BUSINESS))
    off = matches(title, fp.POST_OFFTOPIC) | matches(F.substring(text, 1, 400), fp.POST_OFFTOPIC) | matches(title, fp.POST_PROMO_TITLE)
    in_region = matches(F.col("channel"), channels) | matches(text, region)
    need = F.when(F.col("comment"), 1).otherwise(2)
    about = matches(title, core) | (core_hits(text, core) >= need)
    abroad = F.col("receive") | matches(focus, fp.POST_CROSS_BORDER)
    passed = (
        ~off & ~matches(title, fp.POST_CONSUMER) & in_region & about & abroad
        & (F.col("receive") | F.col("business"))
        & ~(matches(focus, fp.POST_CONSUMER) & ~F.col("receive"))
    )
    return once(df, voice_pass=F.coalesce(passed, F.lit(False)))


def providers_of(text: Column, providers: list[str] | None = None) -> Column:
    """Distinct provider mentions in order of appearance, lower case, single-spaced."""
    pattern = "(?i)" + ascii_regex(words(providers or fp.POST_PROVIDERS))
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"\s+", " ")))


def voice_tags(posts: DataFrame, intents: RulePack = INTENTS, segments: RulePack = SEGMENTS,
               segment_fit: dict | None = None) -> DataFrame:
    """Adds intents, main intent, segment, fit, providers, unhappy and restricted.  Needs text, focus."""
    text, focus = F.col("text"), F.col("focus")
    fit_of = segment_fit or fp.POST_SEGMENT_FIT
    df = once(posts, providers=providers_of(text), rule_intents=intents.all(focus))
    df = once(df, unhappy=(F.size("providers") > 0) & matches(focus, fp.POST_UNHAPPY))
    df = df.withColumn(
        "intents",
        F.when(F.col("unhappy"), F.array_append("rule_intents", F.lit(fp.POST_INTENT_COMPLAINT))).otherwise(F.col("rule_intents")),
    )
    df = df.withColumn("intent", F.coalesce(F.get(F.col("rule_intents"), 0), F.lit(fp.POST_INTENT_DEFAULT)))
    df = df.withColumn(
        "segment", F.coalesce(segments.first(focus), segments.first(text), F.lit(fp.POST_SEGMENT_DEFAULT))
    )
    cards, accounts = matches(focus, fp.POST_FIT_CARDS[1]), matches(focus, fp.POST_FIT_ACCOUNTS[1])
    by_segment = None
    for k, v in fit_of.items():
        by_segment = F.when(F.col("segment") == k, v) if by_segment is None else by_segment.when(F.col("segment") == k, v)
    df = df.withColumn(
        "fit",
        F.when(cards & accounts, f"{fp.POST_FIT_ACCOUNTS[0]} + {fp.POST_FIT_CARDS[0]}").when(cards, fp.POST_FIT_CARDS[0])
        .when(accounts, fp.POST_FIT_ACCOUNTS[0]).otherwise(by_segment),
    )
    return df.withColumn("restricted", extract(text, fp.POST_RESTRICTED))


def score_parts(posts: DataFrame) -> dict[str, Column]:
    """The six weighted boolean signals of a tagged post."""
    text, focus = F.col("text"), F.col("focus")
    has = lambda x: F.array_contains("rule_intents", x)
    return {
        "seeking": has("switching"),
        "business": F.col("business") | F.col("receive"),
        "problem": has("blocked") | has("fees") | has("compliance") | matches(focus, fp.POST_PROBLEM),
        "abroad": F.col("receive") | matches(text, fp.POST_REVENUE_ABROAD),
        "unhappy": F.col("unhappy"),
        "urgent": matches(text, fp.POST_URGENT),
    }


def score_voice(posts: DataFrame, as_of: Column, parts: dict[str, Column] | None = None,
                points: dict[str, int] | None = None, date: str = "published_at") -> DataFrame:
    """Adds score (0..100), band, importance and the array of signals that fired."""
    parts = parts or score_parts(posts)
    points = points or fv.VOICE_POINTS
    total = F.lit(0)
    for k, on in parts.items():
        total = total + F.when(on, points[k]).otherwise(0)
    stale = older_than(F.col(date), as_of, fv.VOICE_STALE_DAYS)
    total = total + F.when(stale, fv.VOICE_STALE_POINTS).otherwise(0)
    df = once(posts, score=clamp(total, 0, 100).cast("int")).withColumn("band", band_of(F.col("score")))
    df = df.withColumn("importance", F.when(F.col("band") == "high", 3).when(F.col("band") == "research", 2).otherwise(1))
    return df.withColumn("fired", F.array_compact(F.array(*[F.when(on, F.lit(k)) for k, on in parts.items()])))


def classify_voice(posts: DataFrame, as_of: Column) -> DataFrame:
    """Gate, tag and score; posts that fail the gate are dropped before tagging."""
    kept = voice_gate(posts).where("voice_pass")
    return score_voice(voice_tags(kept), as_of)
