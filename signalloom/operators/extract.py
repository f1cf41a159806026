"""From headlines, directory entries and landed model output to lead mentions.

All three produce the same record (``LEAD_MENTION`` fields) with column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_packs as fp
from ..functions import fixed_values as fv
from ..functions.packs import RulePack
from ..functions.regex import ascii_regex, extract, let, matches, phrases, words
from ..functions.text import clip_text, domain_of, norm_stage, parse_money, raise_amount, strip_own_name
from .gates import is_enterprise, plausible_name
from .people import team_size
from .state import once

SECTOR_PACK = RulePack.of(fp.SECTORS)
MARKET_PACK = RulePack.of(fp.MARKETS)


def guess_sector(text: Column) -> Column:
    return SECTOR_PACK.first(text, "Other")


def detect_markets(text: Column) -> Column:
    return MARKET_PACK.all(text)


def clean_head(head: Column, trims=fp.HEAD_TRIMS) -> Column:
    """The company name inside the words before a headline's verb: ``trims`` are cut off one after another.

    A trim that must leave a name is taken back where nothing with a capital or a digit is left.
    """
    h = head
    for pattern, must_leave_name in trims:
        rest = F.trim(F.regexp_replace(h, ascii_regex(pattern), ""))
        h = F.when(rest.rlike("^[A-Za-z0-9]") & rest.rlike("[A-Z0-9]"), rest).otherwise(h) if must_leave_name else rest
    return h


def headline_leads(items: DataFrame, competitors=None, positive=None, enterprise=None, blocklist=None) -> DataFrame:
    """One mention per headline that follows a known shape.

    Shapes in order: funding verb, investor first, expansion verb with a market
    abroad, "Show" launch.  ``items``: item_id, title, summary.
    """
    title, summary = F.col("title"), F.coalesce("summary", F.lit(""))
    text = F.concat(title, F.lit(". "), summary)
    fund = rf"^(.*?)\s+({fp.FUNDING_VERBS})\b"
    grow = rf"^(.*?)\s+({fp.EXPANSION_VERBS})\b"
    inv = (rf"\b(?:{fp.INVESTOR_VERBS})\b.*?\b(?:{fp.INVESTOR_TARGETS})\s+"
           r"([A-Z][\w.&'’-]*(?:\s+[A-Z][\w.&'’-]*){0,2})")
    show = r"^Show HN:\s*(.+?)\s*(?:\s[–—-]\s|:|,|$)"
    df = once(
        items, text=text, f_head=extract(title, fund, 1), f_verb=extract(title, fund, 2), e_head=extract(title, grow, 1),
        e_verb=extract(title, grow, 2), i_name=extract(title, inv, 1, ignore_case=False), s_name=extract(title, show, 1, ignore_case=False))
    raising = matches(F.col("f_verb"), fp.FUNDING_VERB_STEMS)
    money = F.coalesce(parse_money(title), F.lit(0.0)) != 0
    is_fund = F.col("f_verb").isNotNull() & raising & (money | matches(F.col("text"), fv.STAGE_PATTERN) | matches(F.col("text"), fp.ROUND_WORDS))
    is_inv = ~raising & F.col("i_name").isNotNull() & matches(title, fp.INVESTOR_CONTEXT)
    abroad = MARKET_PACK.any(title)
    is_grow = F.col("e_verb").isNotNull() & abroad & ~matches(F.col("e_verb"), "acquires|partners")
    # A plain if-chain: the first shape that applies decides, even when its name fails later.
    shape = F.when(is_fund, "fund").when(is_inv, "inv").when(is_grow, "grow").when(F.col("s_name").isNotNull(), "show")
    df = once(df, shape=shape).where("shape IS NOT NULL")
    raw = F.when(F.col("shape") == "fund", F.col("f_head")).when(F.col("shape") == "inv", F.col("i_name")).otherwise(F.col("e_head"))
    df = once(df, raw_head=raw)
    df = once(df, name=F.when(F.col("shape") == "show", F.trim("s_name")).otherwise(clean_head(F.col("raw_head"))))
    df = df.where(F.coalesce(plausible_name(F.col("name"), blocklist, competitors), F.lit(False)))
    kind = (
        F.when(F.col("shape").isin("fund", "inv"), "funding").when(F.col("shape") == "show", "launch")
        .when(matches(F.col("e_verb"), "launches$"), "launch").otherwise("expansion")
    )
    df = once(df, type=kind, bare=strip_own_name(F.col("text"), F.col("name")))
    funding = F.col("type") == "funding"
    df = once(df, amount_text=F.when(funding, F.coalesce(raise_amount(title), raise_amount(summary))))
    df = once(df, amount_usd_m=parse_money(F.col("amount_text")), found=detect_markets(F.col("bare")))
    found = F.col("found")
    ordered = F.concat(F.array_remove(found, fp.GLOBAL_MARKET), F.filter(found, lambda m: m == fp.GLOBAL_MARKET))
    led = F.trim(extract(F.col("text"), r"led by ([A-Z][^,.;()]+?)(?:,|\.|;| and | with | along| alongside| to |$)", 1, ignore_case=False))
    big = is_enterprise(F.col("name"), enterprise) | (F.coalesce("amount_usd_m", F.lit(0.0)) > 150) | matches(F.col("text"), fp.LISTED_WORDS)
    none = F.array().cast("array<string>")
    return df.select(
        *[c for c in items.columns if c not in ("title", "summary")],
        "name", F.lit(None).cast("string").alias("website"), F.lit(True).alias("in_region"),
        extract(F.col("text"), words(fp.CITIES), 0, ignore_case=False).alias("city"), guess_sector(F.col("text")).alias("sector"),
        F.when(big, "enterprise").otherwise("startup").alias("size"),
        clip_text(F.when(summary != "", summary).otherwise(title), 220).alias("description"),
        ordered.alias("markets"), team_size(F.col("text")).alias("team"),
        F.when(funding, 0.6).otherwise(0.45).alias("confidence"), "type", title.alias("title"), clip_text(summary, 400).alias("summary"),
        F.when(funding, norm_stage(F.col("text"))).alias("stage"), "amount_text", "amount_usd_m",
        let(led, lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(none)).alias("investors"),
        F.slice(RulePack.of_phrases(positive or fv.POSITIVE_KEYWORDS).all(F.col("bare")), 1, 6).alias("signals"),
        RulePack.of_phrases(competitors or fv.COMPETITORS).all(F.col("text")).alias("competitors"),
    ).withColumn("sells_intl", F.when(F.size("markets") > 0, "likely").otherwise("unknown"))


def structured_leads(items: DataFrame, directory: str = "Directory", deal: str = "standard deal", amount_usd_m: float = 0.5) -> DataFrame:
    """Mentions out of directory entries: no text analysis, fixed stage and amount."""
    e = F.col("entity")
    text = F.concat_ws(" ", e["description"], e["industry"], F.coalesce("summary", F.lit("")))
    b2b = matches(e["industry"], fp.B2B_WORDS)
    found = detect_markets(text)
    markets = F.when(F.size(found) > 0, found).when(b2b, F.array(F.lit("US"), F.lit(fp.GLOBAL_MARKET))).otherwise(F.array().cast("array<string>"))
    hiring = F.coalesce(e["hiring"], F.lit(False))
    return items.where(F.col("entity").isNotNull()).select(
        "item_id", e["name"].alias("name"), e["website"].alias("website"), e["logo"].alias("logo"), e["city"].alias("city"),
        guess_sector(F.concat_ws(" ", e["industry"], e["description"])).alias("sector"), F.lit("startup").alias("size"),
        clip_text(F.coalesce(e["description"], F.col("summary")), 220).alias("description"), markets.alias("markets"),
        F.when(b2b | (F.size(found) > 0), "likely").otherwise("unknown").alias("sells_intl"),
        F.when(e["team_size"] > 0, e["team_size"]).alias("team_n"), F.lit(0.8).alias("confidence"), F.lit("directory").alias("type"),
        F.concat(F.lit(f"Backed by {directory} ("), e["batch"], F.lit(")"), F.when(hiring, ", currently hiring").otherwise("")).alias("title"),
        F.lit("Seed").alias("stage"), F.lit(f"${amount_usd_m}M ({deal})").alias("amount_text"), F.lit(amount_usd_m).alias("amount_usd_m"),
        F.array(F.lit(directory)).alias("investors"),
        F.array_compact(F.array(F.lit("directory-backed"), F.when(b2b, "sells to global B2B buyers"), F.when(hiring, "hiring"))).alias("signals"),
    )


def merge_model_verdicts(items: DataFrame, outputs: DataFrame) -> DataFrame:
    """Combine landed model verdicts with the rules' verdicts.

    ``items``: batch_id, i, rule_category, rule_importance, rule_topic, rule_score.
    ``outputs``: batch_id, i, category, importance, advice; a batch without any output
    failed and falls back to the rules.  The model may veto or sharpen; score, topic and
    the voice category stay with the rules.
    """
    answered = outputs.select("batch_id").distinct().withColumn("answered", F.lit(True))
    o = outputs.select("batch_id", "i", F.struct("category", "importance", "advice").alias("m"))
    j = items.join(answered, "batch_id", "left").join(o, ["batch_id", "i"], "left")
    model = F.coalesce("answered", F.lit(False))
    # The model can only refine what the rules let through.
    keep = F.col("rule_category").isNotNull() & (~model | F.col("m.category").isNotNull())
    category = F.when(model & (F.col("rule_category") != "voice"), F.col("m.category")).otherwise(F.col("rule_category"))
    return j.select(
        "batch_id", "i", F.when(model, "model").otherwise("rules").alias("via"),
        F.when(keep, category).alias("category"),
        F.when(keep, F.when(model, F.coalesce("m.importance", "rule_importance")).otherwise(F.col("rule_importance"))).alias("importance"),
        F.when(keep, F.col("rule_topic")).alias("topic"), F.when(keep, F.col("rule_score")).alias("score"))


def clean_model_leads(leads: DataFrame) -> DataFrame:
    """Clamp confidence (0 or missing counts as .5), drop invalid websites, dedupe markets, <= 6 people, tidy stage."""
    conf = F.coalesce("confidence", F.lit(0.0))
    return leads.withColumns({
        "website": F.when(domain_of(F.col("website")).isNotNull(), F.col("website")),
        "people": F.slice(F.coalesce("people", F.array().cast("array<string>")), 1, 6),
        "markets": F.array_distinct(F.coalesce("markets", F.array().cast("array<string>"))),
        "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(conf == 0, 0.5).otherwise(conf))),
        "stage": F.coalesce(norm_stage(F.col("stage")), F.nullif("stage", F.lit(""))),
    })
