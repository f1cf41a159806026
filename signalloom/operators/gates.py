"""Item gates: cheap predicates that run before any expensive step.

The gates add columns or filter; none of them shuffles, except the name
block list, which is a small literal set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_packs as fp
from ..functions import fixed_values as fv
from ..functions.numeric import older_than
from ..functions.packs import RulePack
from ..functions.regex import matches, words
from ..functions.text import norm_name
from .state import once

GATE_PACK = RulePack.of(fp.GATE_RULES)


def item_text(title: Column, summary: Column) -> Column:
    return F.concat_ws(" ", title, F.coalesce(summary, F.lit("")))


def prefilter(
    items: DataFrame,
    pack: RulePack = GATE_PACK,
    assumed_sources: str = fp.REGION_ASSUMED_SOURCES,
    strict_kind: str = "hn",
    noise_reasons: dict | None = None,
    with_hits: bool = True,
) -> DataFrame:
    """Route every item and say why it was dropped.

    Needs title, summary, source_id, kind, category, assume_region; optional
    ``structured``, ``intel_pass`` and ``voice_pass`` booleans.  Adds ``hits``,
    ``passed``, ``route`` and ``reason``.  One CASE chain, so drop counts per
    reason come from the same pass.  Without ``hits`` (``with_hits``) an item meets
    only the rules that its reason depends on, the others are not asked.
    """
    reasons = {
        "intel": "no relevant topic", "voice": "no business paid from abroad", "noise": "market noise",
        "intent": "no funding, expansion or launch signal", "region": "no region signal", **(noise_reasons or {}),
    }
    has = set(items.columns)
    structured = F.col("structured") if "structured" in has else F.lit(False)
    intel_ok = F.col("intel_pass") if "intel_pass" in has else F.lit(True)
    voice_ok = F.col("voice_pass") if "voice_pass" in has else F.lit(True)
    text = item_text(F.col("title"), F.col("summary"))
    assumed = F.coalesce(F.col("assume_region"), F.lit(False)) | F.col("source_id").rlike(assumed_sources)
    route = (
        F.when(structured, "structured").when(F.col("category") == "intel", "intel")
        .when(F.col("category") == "voice", "voice").otherwise("leads")
    )

    def reason(hit) -> Column:
        intent = hit("funding") | hit("expansion") | hit("launch") | hit("pain")
        region = F.when(F.col("kind") == strict_kind, hit("region")).otherwise(assumed | hit("region"))
        return (
            F.when(structured, F.lit(None).cast("string"))
            .when(F.col("category") == "intel", F.when(~intel_ok, reasons["intel"]))
            .when(F.col("category") == "voice", F.when(~voice_ok, reasons["voice"]))
            .when(hit("noise") & ~hit("funding"), reasons["noise"])
            .when(~intent, reasons["intent"])
            .when(~region, reasons["region"])
        )

    if with_hits:
        df = once(items, hits=pack.hits(text))
        df = once(df, reason=reason(lambda k: F.col("hits")[k]))
    else:
        df = once(items, reason=pack.asked(text, reason))
    df = df.withColumn("passed", F.col("reason").isNull())
    return df.withColumn("route", F.when(F.col("passed"), route))


def age_gate(items: DataFrame, as_of: Column, days: float = fv.MAX_ITEM_AGE_DAYS, date: str = "published_at") -> DataFrame:
    """Keep items that are recent, undated, or structured."""
    structured = F.col("structured") if "structured" in items.columns else F.lit(False)
    return items.where(structured | ~older_than(F.col(date), as_of, days))


def must_match(items: DataFrame, patterns: dict[str, str], default: str | None = None) -> DataFrame:
    """Per-source text filter; sources without a pattern keep everything."""
    text = item_text(F.col("title"), F.col("summary"))
    keep = None
    for source, pattern in patterns.items():
        test = F.col("source_id") == source
        keep = F.when(test, matches(text, pattern)) if keep is None else keep.when(test, matches(text, pattern))
    rest = F.lit(True) if default is None else matches(text, default)
    return items.where(rest if keep is None else keep.otherwise(rest))


def drop_incomplete(items: DataFrame) -> DataFrame:
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return items.where(filled("url") & filled("title"))


def min_confidence(mentions: DataFrame, floor: float = fv.MIN_CONFIDENCE) -> DataFrame:
    return mentions.where(F.coalesce(F.col("confidence"), F.lit(1.0)) >= floor)


def valid_name(name: Column, blocklist=None, competitors=None) -> Column:
    """Length 2..60, not on a list (case-insensitive), and something left after normalising."""
    banned = [x.lower() for x in (blocklist or fv.NAME_BLOCKLIST) + (competitors or fv.COMPETITORS)]
    n = F.trim(name)
    return F.length(n).between(2, 60) & ~F.lower(n).isin(*banned) & (norm_name(n) != "")


def plausible_name(name: Column, blocklist=None, competitors=None) -> Column:
    """Does a phrase cut out of a headline look like a company name?"""
    banned = [x.lower() for x in (blocklist or fv.NAME_BLOCKLIST) + (competitors or fv.COMPETITORS)]
    n_words = F.size(F.split(name, r"\s+"))
    return (
        F.length(name).between(2, 40)
        & name.rlike("^[A-Za-z0-9]")
        & (n_words <= 4)
        & ~(name.rlike("^[a-z]") & ~name.rlike("[A-Z]"))
        & ~(matches(name, words([fp.GENERIC_NAME_WORDS])) & (n_words > 1))
        & ~matches(name, words([fp.ROLE_NAME_WORDS]))
        & ~F.lower(name).isin(*banned)
    )


def is_enterprise(name: Column, names: list[str] | None = None) -> Column:
    """Watch-list match: equal, followed by a space, or a prefix when the entry has 4+ characters."""
    lc = F.lower(name)
    tests = [
        (lc == e) | lc.startswith(e if len(e) >= 4 else e + " ")
        for e in [x.lower() for x in (names or fv.ENTERPRISE_NAMES)]
    ]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def flag_enterprise(companies: DataFrame, watch: list[str] | None = None) -> DataFrame:
    return companies.withColumn("enterprise", is_enterprise(F.col("name"), watch))
