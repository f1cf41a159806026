"""The transparent company score: eight weighted components and four penalties.

A pure function of companies, their signals, a configuration and one clock value.
Signals aggregate to one row per company with map-side combine; everything after
that is column arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_packs as fp
from ..functions import fixed_values as fv
from ..functions.numeric import age_days, clamp, half_life, lookup, round_half_up
from ..functions.packs import RulePack
from ..functions.regex import matches, phrases
from ..functions.text import format_money, is_late_stage, strip_own_name
from .gates import is_enterprise
from .state import cut, once


@dataclass(frozen=True)
class ScoreConfig:
    weights: dict = field(default_factory=lambda: dict(fv.WEIGHTS))
    penalties: dict = field(default_factory=lambda: dict(fv.PENALTIES))
    preferred_stages: list = field(default_factory=lambda: list(fv.PREFERRED_STAGES))
    ok_stages: list = field(default_factory=lambda: list(fv.OK_STAGES))
    ticket_range: tuple = fv.TICKET_RANGE_USD_M
    half_life_days: float = fv.HALF_LIFE_DAYS
    sectors: dict = field(default_factory=lambda: dict(fv.SECTOR_WEIGHTS))
    positive: list = field(default_factory=lambda: list(fv.POSITIVE_KEYWORDS))
    negative: list = field(default_factory=lambda: list(fv.NEGATIVE_KEYWORDS))
    competitor_mode: str = "opportunity"
    enterprise_names: list = field(default_factory=lambda: list(fv.ENTERPRISE_NAMES))
    threshold: int = fv.THRESHOLD
    home_currency: str = "INR"
    own_brand: str | None = None

    def with_(self, **changes) -> "ScoreConfig":
        return replace(self, **changes)


LABELS = {
    "funding": "Funding", "international": "International intent", "sector": "Sector fit",
    "paymentStack": "Payment stack", "pain": "Payment pain", "momentum": "Momentum",
    "corroboration": "Corroboration", "novelty": "Novelty", "enterprise": "Large enterprise",
    "notInRegion": "Not in the region", "negativeKeyword": "Negative news", "lateStage": "Late stage",
}


def _funding_fraction(cfg: ScoreConfig, as_of: Column) -> Column:
    age = F.greatest(F.lit(0.0), age_days(F.col("occurred_at"), as_of))
    stage, amount = F.col("stage"), F.col("amount_usd_m")
    stage_f = (
        F.when(F.coalesce(stage, F.lit("")) == "", 0.6).when(stage.isin(*cfg.preferred_stages), 1.0)
        .when(stage.isin(*cfg.ok_stages), 0.6).when(is_late_stage(stage), 0.3).otherwise(0.5)
    )
    lo, hi = cfg.ticket_range
    amount_f = F.when(amount.isNull(), 0.75).when(amount < lo, 0.7).when(amount > hi, 0.55).otherwise(1.0)
    type_f = F.when(F.col("type") == "directory", 0.7).otherwise(1.0)
    recency = F.coalesce(half_life(age, cfg.half_life_days), F.lit(0.0))
    return F.when(F.col("type").isin("funding", "directory"), recency * stage_f * amount_f * type_f)


def signal_features(signals: DataFrame, companies: DataFrame, cfg: ScoreConfig, as_of: Column) -> DataFrame:
    """One row per company out of its signals.

    Only companies whose own name contains a keyword need that name blanked, so
    only those are joined to the signals before the aggregate.
    """
    pos, neg = RulePack.of_phrases(cfg.positive), RulePack.of_phrases(cfg.negative)
    named = companies.where(pos.any(F.col("name")) | neg.any(F.col("name"))).select("company_id", F.col("name").alias("own"))
    s = signals.join(named, "company_id", "left")
    text = F.concat_ws(" ", "title", F.coalesce("summary", F.lit("")), F.array_join("tags", " "))
    text = F.when(F.col("own").isNull(), text).otherwise(strip_own_name(text, F.coalesce("own", F.lit("-")), True))
    s = s.withColumn("_text", text)
    text = F.col("_text")
    has = lambda p: F.exists("competitors", lambda c: c.rlike("(?i)" + "|".join(p)))
    fund = F.col("type").isin("funding", "directory")
    age = age_days(F.col("occurred_at"), as_of)
    return s.groupBy("company_id").agg(
        F.max(_funding_fraction(cfg, as_of)).alias("funding_frac"),
        F.bit_or(pos.mask(text)).alias("pos_mask"), F.bit_or(neg.mask(text)).alias("neg_mask"),
        F.max(has(fv.CROSS_BORDER_PROVIDERS)).alias("m_cross"), F.max(has(fv.DOMESTIC_PROVIDERS)).alias("m_domestic"),
        F.max(F.size("competitors") > 0).alias("m_any"), F.max(F.col("type") == "pain").alias("has_pain"),
        F.sum(F.when(F.col("type").isin(*fv.MOMENTUM_TYPES) & (age < 60), 1).otherwise(0)).alias("momentum"),
        F.sum(F.coalesce("corroborations", F.lit(1))).alias("corroborations"),
        F.max(fund & is_late_stage(F.col("stage"))).alias("late"),
    )


def score_company(companies: DataFrame, signals: DataFrame, as_of: Column, cfg: ScoreConfig | None = None,
                  learned: DataFrame | None = None) -> DataFrame:
    """Companies with ``score`` (0..100) and ``breakdown`` array<struct<key,label,points,max>>.

    ``companies``: company_id, name, description, sector, size, in_region, sells_intl,
    markets, confidence, first_seen_at and the site facts enriched, providers,
    currencies, ships_abroad, locales.  ``learned``: sector, weight.
    """
    cfg = cfg or ScoreConfig()
    pos, neg = RulePack.of_phrases(cfg.positive), RulePack.of_phrases(cfg.negative)
    c = companies.join(signal_features(signals, companies, cfg, as_of), "company_id", "left")
    if learned is not None:
        c = c.join(learned.select("sector", F.col("weight").alias("learned")), "sector", "left")
    else:
        c = c.withColumn("learned", F.lit(0.0))
    yes = lambda n: F.coalesce(F.col(n), F.lit(False))
    num = lambda n: F.coalesce(F.col(n), F.lit(0))
    own_text = F.when(pos.any(F.col("name")) | neg.any(F.col("name")), strip_own_name(F.col("description"), F.col("name"), True)).otherwise(F.col("description"))
    c = c.withColumns({
        "pos_mask": num("pos_mask").bitwiseOR(pos.mask(own_text)), "neg_mask": num("neg_mask").bitwiseOR(neg.mask(own_text))})

    concrete = F.size(F.filter("markets", lambda m: m != fp.GLOBAL_MARKET))
    foreign = F.exists("currencies", lambda x: x != cfg.home_currency)
    add = lambda cond, v: F.when(cond, v).otherwise(0.0)
    intl = (
        lookup(F.col("sells_intl"), fv.SELLS_ABROAD_BASE, 0.1)
        + F.least(F.lit(0.3), concrete * F.lit(0.1)) + F.least(F.lit(0.2), F.bit_count("pos_mask") * F.lit(0.05))
        + add(yes("enriched") & foreign, 0.15) + add(yes("enriched") & yes("ships_abroad"), 0.15)
        + add(yes("enriched") & (num("locales") > 1), 0.05)
    )
    c = once(c, intl=intl)
    has = lambda p: F.exists("providers", lambda x: x.rlike("(?i)" + "|".join(p)))
    cross = has(fv.CROSS_BORDER_PROVIDERS) | yes("m_cross")
    domestic = has(fv.DOMESTIC_PROVIDERS) | yes("m_domestic")
    known = (F.size("providers") > 0) | yes("m_any")
    wide = F.col("intl") > 0.4
    ours = F.exists("providers", lambda x: x.rlike("(?i)" + phrases([cfg.own_brand]))) if cfg.own_brand else F.lit(False)
    if cfg.competitor_mode == "deprioritize":
        stack = F.when(cross, 0.0).when(domestic, 0.6).otherwise(0.5)
    else:
        stack = F.when(cross, 1.0).when(domestic, F.when(wide, 0.7).otherwise(0.4)).otherwise(0.4)
    pay = F.when(ours, 0.0).when(known, stack).when(yes("enriched"), F.when(wide, 0.35).otherwise(0.15)).otherwise(0.0)
    age = age_days(F.col("first_seen_at"), as_of)
    sector_base = lookup(F.col("sector"), cfg.sectors, cfg.sectors.get("Other", fv.SECTOR_FALLBACK))
    fractions = {
        "funding": F.coalesce("funding_frac", F.lit(0.0)),
        "international": F.col("intl"),
        "sector": sector_base + F.coalesce("learned", F.lit(0.0)),
        "paymentStack": pay,
        "pain": yes("has_pain").cast("double"),
        "momentum": num("momentum") / 2,
        "corroboration": (num("corroborations") - 1) / 3,
        "novelty": F.coalesce(F.when(age < 3, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (age - 3) / 14)), F.lit(0.0)),
    }
    points = {
        k: round_half_up(F.lit(float(cfg.weights.get(k, 0))) * clamp(f, 0.0, 1.0)).cast("int") for k, f in fractions.items()
    }
    big = (F.col("size") == "enterprise") | is_enterprise(F.col("name"), cfg.enterprise_names)
    fines = {
        "enterprise": big, "notInRegion": ~F.coalesce("in_region", F.lit(True)),
        "negativeKeyword": F.col("neg_mask") != 0, "lateStage": yes("late"),
    }
    c = once(
        c, **{f"p_{k}": v for k, v in points.items()},
        **{f"p_{k}": F.when(v, int(cfg.penalties[k])) for k, v in fines.items()})
    parts = [F.col(f"p_{k}") for k in points] + [F.coalesce(f"p_{k}", F.lit(0)) for k in fines]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    sure = F.lit(0.75) + F.lit(0.25) * clamp(F.coalesce("confidence", F.lit(0.5)), 0.5, 1.0)
    part = lambda k, top: F.when(F.col(f"p_{k}").isNotNull(), F.struct(
        F.lit(k).alias("key"), F.lit(LABELS[k]).alias("label"), F.col(f"p_{k}").alias("points"), F.lit(int(top)).alias("max")))
    score = round_half_up(clamp(total * sure, 0.0, 100.0)).cast("int")
    breakdown = F.array_compact(F.array(*[part(k, cfg.weights.get(k, 0)) for k in points], *[part(k, 0) for k in fines]))
    return c.select(*companies.columns, score.alias("score"), breakdown.alias("breakdown"))


def _filled(template: str, texts: dict[str, Column]) -> Column:
    """A template's words with the columns its {names} stand for."""
    pieces = [(F.lit(words), texts.get(name)) for words, name, _, _ in Formatter().parse(template)]
    return F.concat(*[x for piece in pieces for x in piece if x is not None])


def _clauses(slots, holds: dict[str, Column], texts: dict[str, Column]) -> Column:
    """One clause per slot: that of the first fact that holds, none if none does."""
    return F.array_compact(F.array(*[
        F.coalesce(*[F.when(F.coalesce(holds[fact], F.lit(False)), _filled(words, texts)) for fact, words in slot]) for slot in slots]))


def explain_score(scored: DataFrame, signals: DataFrame, as_of: Column, cfg: ScoreConfig | None = None,
                  triggers=fp.WHY_TRIGGERS, fits=fp.WHY_FITS) -> DataFrame:
    """Adds ``why``: what happened and why the company fits, as the clauses of two tables say it.

    The newest funding and the newest expansion, export or launch count; prices in the home currency say nothing.
    A company without signals gets the sentence for no trigger.
    """
    newest = lambda kinds, *cols: F.max_by(F.struct(*cols), F.when(F.col("type").isin(*kinds), F.struct("occurred_at", -F.col("signal_id"))))
    c = scored.join(signals.groupBy("company_id").agg(
        newest(["funding"], "stage", "amount_usd_m", "occurred_at").alias("raised"), newest(["expansion", "export", "launch"], "type").alias("move"),
        F.max(F.col("type") == "directory").alias("listed"), F.max(F.col("type") == "pain").alias("pained")), "company_id", "left")
    places, moved, raised = F.filter("markets", lambda m: m != fp.GLOBAL_MARKET), F.col("move").isNotNull(), F.col("raised").isNotNull()
    foreign = F.filter("currencies", lambda x: x != (cfg or ScoreConfig()).home_currency)
    paid = F.exists("breakdown", lambda p: (p["key"] == "paymentStack") & (p["points"] > 0))
    launched, abroad = F.col("move.type") == "launch", F.size(places) > 0
    dated = F.col("raised.occurred_at").isNotNull()  # greatest() would make no date day 0
    days = F.when(dated, round_half_up(F.greatest(F.lit(0.0), age_days(F.col("raised.occurred_at"), as_of))))
    optional = lambda template, x: F.coalesce(_filled(template, {"x": x}), F.lit(""))
    texts = {
        "name": F.col("name"), "sector": F.col("sector"), "platform": F.col("platform"), "stage": F.col("raised.stage"),
        "of": optional(fp.WHY_AMOUNT, format_money(F.col("raised.amount_usd_m"))), "ago": optional(fp.WHY_AGO, days.cast("string")),
        "markets": F.array_join(F.slice(places, 1, fp.WHY_MARKETS), ", "), "currencies": F.array_join(foreign, "/"),
        "providers": F.array_join("providers", ", ")}
    holds = {
        "round": raised & F.col("raised.stage").isNotNull(), "capital": raised, "listed": F.col("listed"),
        "launched into": launched & abroad, "launched": launched, "expands into": moved & abroad, "expands": moved, "pained": F.col("pained"),
        "sells into": ~moved & (F.col("sells_intl") == "yes") & abroad, "sells": ~moved & (F.col("sells_intl") == "yes"),
        "likely": ~moved & (F.col("sells_intl") == "likely"), "foreign prices": F.size(foreign) > 0, "ships": F.col("ships_abroad"),
        "collects": paid & (F.size("providers") > 0), "platform": F.col("platform").isNotNull()}
    c = once(c, happened=_clauses(triggers, holds, texts), suits=_clauses(fits, holds, texts))
    story = F.when(F.size("happened") > 0, F.array_join("happened", " and ")).otherwise(fp.WHY_NOTHING)
    why = F.concat(F.col("name"), F.lit(" "), story, F.lit("."), F.when(F.size("suits") > 0, F.concat(F.lit(" Fit: "), F.array_join("suits", "; "), F.lit("."))).otherwise(""))
    return c.withColumn("why", why).drop("raised", "move", "listed", "pained", "happened", "suits")


def rescore_all(companies: DataFrame, signals: DataFrame, as_of: Column, cfg: ScoreConfig, learned: DataFrame | None = None) -> DataFrame:
    """Scores after a configuration change: a plain recompute."""
    return score_company(companies, signals, as_of, cfg, learned)


def config_preview(companies: DataFrame, signals: DataFrame, as_of: Column, current: ScoreConfig, draft: ScoreConfig,
                   top: int = 40, shown: int = 15) -> tuple[DataFrame, DataFrame]:
    """The current top leads under a draft: (rows shown, counts crossing the threshold)."""
    live = companies.where("status <> 'dismissed'")
    before = score_company(live, signals, as_of, current).orderBy(F.desc("score"), "company_id").limit(top)
    # Fixed once: what follows reads these rows several times.
    head = cut(before.withColumnRenamed("score", "before").drop("breakdown"))
    near = signals.join(head.select("company_id"), "company_id", "left_semi")
    after = score_company(head, near, as_of, draft).withColumnRenamed("score", "after")
    hi = draft.threshold
    moved = after.agg(
        F.count(F.when((F.col("after") >= hi) & (F.col("before") < hi), 1)).alias("into_high"),
        F.count(F.when((F.col("after") < hi) & (F.col("before") >= hi), 1)).alias("out_of_high"))
    rows = after.select("company_id", "name", "sector", "before", "after").orderBy(F.desc("after"), F.desc("before"), "company_id").limit(shown)
    return rows, moved
