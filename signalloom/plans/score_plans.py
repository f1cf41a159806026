"""The score model over customers and their orders."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.packs import RulePack
from ..operators import score
from .bindings import AS_OF_SIGNALS_US, as_of_signals
from .gate_plans import re_sql
from .registry import query

_POS, _NEG = RulePack.of_phrases(fv.POSITIVE_KEYWORDS), RulePack.of_phrases(fv.NEGATIVE_KEYWORDS)


def _flags(pack, expr, prefix):
    return ", ".join(f"max(CASE WHEN {re_sql(expr, r.pattern)} THEN 1 ELSE 0 END) AS {prefix}{i}" for i, r in enumerate(pack.rules))


_AGE = f"greatest(0.0, ({AS_OF_SIGNALS_US} - occurred_us) / 86400000000.0)"
_FUND_TMPL = """max(CASE WHEN type IN ('funding', 'directory') THEN pow(0.5, {age} / {hl}) *
  CASE WHEN stage IS NULL THEN 0.6E0 WHEN stage IN ('Seed', 'Series A') THEN 1.0E0 WHEN stage = 'Series D' THEN 0.3E0 ELSE 0.5E0 END *
  CASE WHEN amount_usd_m IS NULL THEN 0.75E0 WHEN amount_usd_m < 0.2 THEN 0.7E0 WHEN amount_usd_m > 40 THEN 0.55E0 ELSE 1.0E0 END *
  CASE WHEN type = 'directory' THEN 0.7E0 ELSE 1.0E0 END END)"""


def scored_cte(name="scored", half_life=30.0, weights=None, learned=False):
    """CTEs of the score model ending in ``name``; needs {companies} and {signals} in the query."""
    w = {k: float(v) for k, v in (weights or fv.WEIGHTS).items()}
    sec = "CASE sector WHEN 'SaaS' THEN 1.0E0 WHEN 'D2C' THEN 1.0E0 WHEN 'Marketplace' THEN 0.75E0 WHEN 'Exporter' THEN 1.0E0 ELSE 0.4E0 END"
    if learned:
        sec += " + coalesce((SELECT weight FROM learned WHERE learned.sector = a.sector), 0.0)"
    pts = lambda k, f: f"CAST(floor({w[k]}E0 * least(1.0E0, greatest(0.0E0, {f})) + 0.5) AS BIGINT)"
    stxt = "(title || ' ' || summary || ' ' || array_to_string(tags, ' '))"
    npos, nneg = len(_POS.rules), len(_NEG.rules)
    kpos = " + ".join(f"greatest(coalesce(kp{i}, 0), CASE WHEN {re_sql('description', r.pattern)} THEN 1 ELSE 0 END)" for i, r in enumerate(_POS.rules))
    kneg = " + ".join([f"coalesce(kn{i}, 0)" for i in range(nneg)])
    return f"""
{name}_f AS (SELECT company_id AS cid, {_FUND_TMPL.format(age=_AGE, hl=half_life)} AS ff, {_flags(_POS, stxt, 'kp')}, {_flags(_NEG, stxt, 'kn')},
   bool_or(list_has_any(competitors, ['Stripe'])) AS m_cross, bool_or(list_has_any(competitors, ['Razorpay'])) AS m_dom, bool_or(type = 'pain') AS has_pain,
   count(*) FILTER (WHERE type IN ('expansion', 'launch') AND ({AS_OF_SIGNALS_US} - occurred_us) / 86400000000.0 < 60) AS mom,
   sum(corroborations) AS corr, bool_or(type IN ('funding', 'directory') AND stage = 'Series D') AS late FROM {{signals}} GROUP BY company_id),
{name}_a AS (SELECT c.*, f.*, {kpos} AS npos, {kneg} AS nneg,
   ({AS_OF_SIGNALS_US} - first_seen_us) / 86400000000.0 AS age FROM {{companies}} c LEFT JOIN {name}_f f ON f.cid = c.company_id),
{name}_b AS (SELECT *, CASE sells_intl WHEN 'yes' THEN 0.7E0 WHEN 'likely' THEN 0.45E0 WHEN 'unknown' THEN 0.1E0 ELSE 0.0E0 END
   + least(0.3E0, len(list_filter(markets, lambda m: m <> 'Global')) * 0.1E0) + least(0.2E0, npos * 0.05E0)
   + CASE WHEN enriched AND list_contains(currencies, 'USD') THEN 0.15E0 ELSE 0.0E0 END + CASE WHEN enriched AND ships_abroad THEN 0.15E0 ELSE 0.0E0 END
   + CASE WHEN enriched AND locales > 1 THEN 0.05E0 ELSE 0.0E0 END AS intl FROM {name}_a),
{name}_c AS (SELECT *, {pts('funding', 'coalesce(ff, 0.0E0)')} AS p1, {pts('international', 'intl')} AS p2, {pts('sector', sec)} AS p3,
   {pts('paymentStack', '''CASE WHEN len(providers) > 0 OR m_cross OR m_dom THEN CASE WHEN list_contains(providers, 'Stripe') OR m_cross THEN 1.0E0
      WHEN list_contains(providers, 'Razorpay') OR m_dom THEN CASE WHEN intl > 0.4 THEN 0.7E0 ELSE 0.4E0 END ELSE 0.4E0 END
      WHEN enriched THEN CASE WHEN intl > 0.4 THEN 0.35E0 ELSE 0.15E0 END ELSE 0.0E0 END''')} AS p4,
   {pts('pain', 'CASE WHEN has_pain THEN 1.0E0 ELSE 0.0E0 END')} AS p5, {pts('momentum', 'coalesce(mom, 0) / 2.0E0')} AS p6,
   {pts('corroboration', '(coalesce(corr, 0) - 1) / 3.0E0')} AS p7, {pts('novelty', 'CASE WHEN age < 3 THEN 1.0E0 ELSE 1.0E0 - (age - 3) / 14 END')} AS p8,
   CASE WHEN size = 'enterprise' THEN -18 ELSE 0 END AS q1, CASE WHEN NOT in_region THEN -40 ELSE 0 END AS q2,
   CASE WHEN nneg > 0 THEN -10 ELSE 0 END AS q3, CASE WHEN late THEN -4 ELSE 0 END AS q4 FROM {name}_b a),
{name} AS (SELECT *, CAST(floor(least(100.0E0, greatest(0.0E0, (p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 + q1 + q2 + q3 + q4) * (0.75E0 + 0.25E0 * greatest(0.5E0, least(1.0E0, confidence))))) + 0.5) AS BIGINT) AS score FROM {name}_c)
"""


SCORED = scored_cte()


def scored_companies(t):
    return score.score_company(t.companies, t.signals, as_of_signals())


@query("score_company", f"WITH {SCORED} SELECT company_id, score, concat_ws(',', p1, p2, p3, p4, p5, p6, p7, p8) AS parts, CAST(q1 + q2 + q3 + q4 AS BIGINT) AS penalty FROM scored")
def _(t):
    s = scored_companies(t)
    pts = F.transform(F.slice("breakdown", 1, 8), lambda p: p["points"].cast("string"))
    fines = F.aggregate(F.slice("breakdown", 9, 8), F.lit(0), lambda a, p: a + p["points"])
    return s.select("company_id", F.col("score").cast("bigint").alias("score"), F.array_join(pts, ",").alias("parts"), fines.cast("bigint").alias("penalty"))


@query("explain_score")
def _(t):
    return score.explain_score(scored_companies(t), t.signals, as_of_signals()).select("company_id", "why")


_DRAFT = {**fv.WEIGHTS, "funding": 10, "pain": 30}


@query("rescore_all", f"WITH {scored_cte('scored', 90.0, _DRAFT)} SELECT company_id, score FROM scored")
def _(t):
    cfg = score.ScoreConfig(weights=_DRAFT, half_life_days=90.0)
    return score.rescore_all(t.companies, t.signals, as_of_signals(), cfg).select("company_id", F.col("score").cast("bigint").alias("score"))


_PREVIEW = f"""{SCORED}, {scored_cte('redo', 90.0, _DRAFT)},
top AS (SELECT company_id, name, sector, score AS before FROM scored WHERE status <> 'dismissed' ORDER BY score DESC, company_id LIMIT 40),
pv AS (SELECT top.*, redo.score AS after FROM top JOIN redo USING (company_id))"""


@query("config_preview", f"WITH {_PREVIEW} SELECT company_id, name, sector, before, after FROM pv ORDER BY after DESC, before DESC, company_id LIMIT 15")
def _(t):
    rows, _ = score.config_preview(t.companies, t.signals, as_of_signals(), score.ScoreConfig(), score.ScoreConfig(weights=_DRAFT, half_life_days=90.0))
    return rows.withColumn("before", F.col("before").cast("bigint")).withColumn("after", F.col("after").cast("bigint"))


@query("config_preview_moved", f"WITH {_PREVIEW} SELECT CAST(count(*) FILTER (WHERE after >= 55 AND before < 55) AS BIGINT) AS into_high, CAST(count(*) FILTER (WHERE after < 55 AND before >= 55) AS BIGINT) AS out_of_high FROM pv")
def _(t):
    _, moved = score.config_preview(t.companies, t.signals, as_of_signals(), score.ScoreConfig(), score.ScoreConfig(weights=_DRAFT, half_life_days=90.0))
    return moved
