"""Entity resolution, merges and folds over customers, suppliers, parts and orders."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import norm_name
from ..operators import merge, resolve, twins
from ..operators.state import once
from .bindings import DAY_US
from .gate_plans import norm_sql
from .registry import query
from .text_plans import SQL_ITEM_TOKENS

# Mentions: each order names its part's maker in one of several spellings.
_MENTION_NAME = (
    "concat(CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN 'The ' ELSE '' END, p_name, "
    "CASE WHEN l_linenumber = 3 THEN ' Labs' WHEN l_linenumber = 4 THEN 's' WHEN l_linenumber = 5 THEN 'x' ELSE '' END)"
)
_MENTION = [
    ("mention_id", "(l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey"), ("name", _MENTION_NAME),
    ("domain", "CASE WHEN l_linenumber = 1 AND p_size > 25 THEN concat(replace(p_name, ' ', ''), '.example.com') WHEN l_linenumber = 6 THEN concat(replace(p_name, ' ', ''), '.example.com') END"),
]
_MENTIONS_SQL = "mentions AS (SELECT DISTINCT " + ", ".join(f"{e} AS {c}" for c, e in _MENTION) + " FROM lineitem JOIN part ON l_partkey = p_partkey)"
# Known companies: the parts' names.
_KNOWN_SQL = f"known AS (SELECT min(p_partkey) AS company_id, {norm_sql('p_name')} AS norm, min(replace(p_name, ' ', '')) || '.example.com' AS domain FROM part GROUP BY 2)"


def mentions(t):
    m = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(*[f"{e} AS {c}" for c, e in _MENTION])
    return once(m.distinct(), norm=norm_name(F.col("name")))


def known(t):
    p = t.part.select("p_partkey", "p_name", norm_name(F.col("p_name")).alias("norm"))
    return p.groupBy("norm").agg(
        F.min("p_partkey").alias("company_id"), F.concat(F.min(F.regexp_replace("p_name", " ", "")), F.lit(".example.com")).alias("domain"),
        F.array(F.min("p_name"), F.concat(F.min("p_name"), F.lit("s"))).alias("aliases"))


@query("match_domain", f"WITH {_MENTIONS_SQL}, {_KNOWN_SQL} SELECT mention_id, company_id FROM mentions JOIN known USING (domain)")
def _(t):
    return resolve.match_domain(mentions(t), known(t)).select("mention_id", "company_id")


@query("match_exact", f"WITH {_MENTIONS_SQL}, {_KNOWN_SQL} SELECT mention_id, company_id FROM mentions JOIN known ON {norm_sql('name')} = norm")
def _(t):
    return resolve.match_exact(mentions(t), known(t)).select("mention_id", "company_id")


@query("match_alias", f"WITH {_MENTIONS_SQL}, {_KNOWN_SQL} SELECT mention_id, min(company_id) AS company_id FROM mentions JOIN known ON {norm_sql('name')} IN (norm, norm || 's') GROUP BY mention_id")
def _(t):
    return resolve.match_alias(mentions(t), known(t)).select("mention_id", "company_id")


@query("match_fuzzy", f"""
WITH {_MENTIONS_SQL}, {_KNOWN_SQL}, m AS (SELECT mention_id, {norm_sql('name')} AS n FROM mentions)
SELECT mention_id, company_id FROM m JOIN known ON left(n, 2) = left(norm, 2) AND length(n) >= 5 AND jaro_winkler_similarity(n, norm) >= 0.94
QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY jaro_winkler_similarity(n, norm) DESC, company_id) = 1
""")
def _(t):
    return resolve.match_fuzzy(mentions(t), known(t), floor_transpositions=True).select("mention_id", "company_id")


@query("match_tiers", f"""
WITH {_MENTIONS_SQL}, {_KNOWN_SQL}, m AS (SELECT mention_id, domain, {norm_sql('name')} AS n FROM mentions),
hit AS (SELECT mention_id, 0 AS r, company_id FROM m JOIN known USING (domain)
 UNION ALL SELECT mention_id, 1, company_id FROM m JOIN known ON n = norm
 UNION ALL SELECT mention_id, 2, min(company_id) FROM m JOIN known ON n IN (norm, norm || 's') GROUP BY mention_id
 UNION ALL SELECT mention_id, 3, company_id FROM m JOIN known ON left(n, 2) = left(norm, 2) AND length(n) >= 5 AND jaro_winkler_similarity(n, norm) >= 0.94
   QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY jaro_winkler_similarity(n, norm) DESC, company_id) = 1)
SELECT m.mention_id, ['domain', 'exact', 'alias', 'fuzzy'][h.r + 1] AS tier, h.company_id FROM m LEFT JOIN (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY mention_id ORDER BY r) = 1) h USING (mention_id)
""")
def _(t):
    return resolve.match_tiers(mentions(t), known(t)).select("mention_id", "tier", "company_id")


@query("resolve_entities")
def _(t):
    return resolve.resolve_entities(mentions(t))


# ---------------------------------------------------------------- merges
_FACTS = [
    ("company_id", "o_custkey"), ("ord", "o_orderkey"), ("name", "concat('Maker ', o_orderpriority)"),
    ("domain", "CASE WHEN o_orderstatus = 'F' THEN concat('d', CAST(o_orderkey AS STRING), '.example.com') END"),
    ("website", "CASE WHEN o_orderstatus = 'O' THEN concat('https://', CAST(o_orderkey AS STRING), '.example.com') END"),
    ("logo", "CASE WHEN o_totalprice > 400000 THEN concat('logo', CAST(o_orderkey AS STRING)) END"),
    ("city", "CASE WHEN o_totalprice < 100000 THEN concat('city', CAST(o_orderkey AS STRING)) END"),
    ("description", "CASE WHEN o_totalprice > 300000 THEN concat('about ', CAST(o_orderkey AS STRING)) END"),
    ("sector", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'SaaS' WHEN o_orderpriority = '2-HIGH' THEN 'D2C' ELSE 'Other' END"),
    ("size", "CASE WHEN o_totalprice > 450000 THEN 'enterprise' WHEN o_totalprice < 200000 THEN 'startup' ELSE 'unknown' END"),
    ("sells_intl", "CASE o_orderpriority WHEN '1-URGENT' THEN 'yes' WHEN '3-MEDIUM' THEN 'likely' WHEN '5-LOW' THEN 'no' ELSE 'unknown' END"),
    ("confidence", "CASE WHEN o_orderstatus = 'F' THEN 0.8E0 ELSE 0.5E0 END"),
]
_FACTS_SQL = "SELECT " + ", ".join(f"{e.replace('AS STRING)', 'AS VARCHAR)')} AS {c}" for c, e in _FACTS) + ", [o_orderpriority, 'status ' || o_orderstatus] AS markets FROM orders"


def facts(t):
    return t.orders.selectExpr(*[f"{e} AS {c}" for c, e in _FACTS], "array(o_orderpriority, concat('status ', o_orderstatus)) AS markets")


_FIRST = ", ".join(f"first({c} ORDER BY ord) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ["domain", "website", "logo", "city", "description"])


@query("merge_company", f"""
WITH f AS ({_FACTS_SQL}),
al AS (SELECT company_id, string_agg(name, ';' ORDER BY o) AS aliases FROM (SELECT company_id, name, min(ord) AS o FROM f GROUP BY company_id, name QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY min(ord)) <= 10) GROUP BY company_id),
mk AS (SELECT company_id, string_agg(m, ';' ORDER BY o) AS markets FROM (SELECT company_id, m, min(o) AS o FROM (SELECT company_id, unnest(markets) AS m, unnest([ord * 2, ord * 2 + 1]) AS o FROM f) GROUP BY ALL) GROUP BY company_id)
SELECT company_id, first(name ORDER BY ord) AS name, {_FIRST}, coalesce(first(sector ORDER BY ord) FILTER (WHERE sector <> 'Other'), 'Other') AS sector,
 coalesce(first(size ORDER BY ord) FILTER (WHERE size <> 'unknown'), 'unknown') AS size,
 ['no', 'unknown', 'likely', 'yes'][max(CASE sells_intl WHEN 'no' THEN 1 WHEN 'unknown' THEN 2 WHEN 'likely' THEN 3 ELSE 4 END)] AS sells_intl,
 max(confidence) AS confidence, any_value(al.aliases) AS aliases, any_value(mk.markets) AS markets
FROM f JOIN al USING (company_id) JOIN mk USING (company_id) GROUP BY company_id
""")
def _(t):
    m = merge.merge_company(facts(t))
    return m.withColumn("aliases", F.array_join("aliases", ";")).withColumn("markets", F.array_join("markets", ";"))


@query("event_twins")
def _(t):
    return twins.event_twins(t.signals)


@query("event_twin_candidates", f"""
SELECT company_id, type, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT company_id, type, occurred_us - lag(occurred_us) OVER (PARTITION BY company_id, type ORDER BY occurred_us, signal_id) AS gap, stage,
   lag(stage) OVER (PARTITION BY company_id, type ORDER BY occurred_us, signal_id) AS prev FROM {{signals}})
WHERE gap < 30 * {DAY_US} AND (type = 'directory' OR stage = prev) GROUP BY ALL
""")
def _(t):
    from pyspark.sql.window import Window

    w = Window.partitionBy("company_id", "type").orderBy("occurred_us", "signal_id")
    s = t.signals.withColumn("gap", F.col("occurred_us") - F.lag("occurred_us").over(w)).withColumn("prev", F.lag("stage").over(w))
    near = s.where((F.col("gap") < 30 * DAY_US) & ((F.col("type") == "directory") | (F.col("stage") == F.col("prev"))))
    return near.groupBy("company_id", "type").agg(F.count("*").alias("n"))


@query("corroborate")
def _(t):
    s = t.signals.withColumn("investors", F.col("competitors"))
    m = twins.corroborate(s, twins.event_twins(t.signals))
    return m.select("stored_id", "corroborations", "stage", F.array_join("tags", ";").alias("tags"), F.array_join("extra_urls", ";").alias("extra_urls"))


@query("pain_events", """
SELECT signal_id, type, title FROM {signals} UNION ALL SELECT signal_id, 'pain', 'Payment friction mentioned' FROM {signals} WHERE summary LIKE '%fraud%'
""")
def _(t):
    m = t.signals.withColumn("payment_pain", F.when(F.col("summary").contains("fraud"), F.col("summary")))
    return merge.pain_events(m).select("signal_id", "type", "title")


_TEAM = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'website' WHEN o_orderpriority = '2-HIGH' THEN 'news' WHEN o_orderpriority = '3-MEDIUM' THEN 'article' ELSE 'stage' END"


@query("best_team_size", f"""
SELECT company_id, source, seq, n FROM (SELECT o_custkey AS company_id, {_TEAM} AS source, o_orderkey AS seq, CAST(floor(o_totalprice / 1000) AS BIGINT) AS n FROM orders)
QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY CASE source WHEN 'website' THEN 4 WHEN 'stage' THEN 1 ELSE 3 END DESC, seq DESC) = 1
""")
def _(t):
    r = t.orders.selectExpr("o_custkey AS company_id", f"{_TEAM} AS source", "o_orderkey AS seq", "CAST(floor(o_totalprice / 1000) AS BIGINT) AS n")
    return merge.best_team_size(r)


@query("merge_enrichment", """
WITH s AS (SELECT s_suppkey AS cid, 'https://' || s_name AS url, s_name AS sd, lower(s_name) || '.example.com' AS dom, CASE WHEN s_acctbal > 3000 THEN 'yes' END AS si FROM supplier)
SELECT company_id, coalesce(url, website) AS website, description, coalesce(dom, domain) AS domain, CASE WHEN si IS NOT NULL AND sells_intl IN ('unknown', 'likely') THEN si ELSE sells_intl END AS sells_intl
FROM {companies} LEFT JOIN s ON cid = company_id
""")
def _(t):
    s = t.supplier.selectExpr("s_suppkey AS company_id", "concat('https://', s_name) AS url", "s_name AS description",
                              "concat(lower(s_name), '.example.com') AS domain", "CASE WHEN s_acctbal > 3000 THEN 'yes' END AS sells_intl")
    return merge.merge_enrichment(t.companies, s).select("company_id", "website", "description", "domain", "sells_intl")


@query("domain_conflict", """
WITH c AS (SELECT c_custkey AS company_id, c_mktsegment || c_nationkey AS domain FROM customer WHERE c_acctbal > 9000),
f AS (SELECT c_custkey AS company_id, c_mktsegment || c_nationkey AS domain FROM customer WHERE c_acctbal > 5000)
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.domain = f.domain AND c.company_id <> f.company_id)
""")
def _(t):
    base = t.customer.selectExpr("c_custkey AS company_id", "concat(c_mktsegment, c_nationkey) AS domain", "c_acctbal")
    return merge.domain_conflict(base.where("c_acctbal > 5000").drop("c_acctbal"), base.where("c_acctbal > 9000")).select("company_id", "domain")


@query("fold_feedback", """
WITH RECURSIVE v AS (SELECT sector, (next - prev) * 0.04E0 AS delta, row_number() OVER (PARTITION BY sector ORDER BY seq) AS i FROM {votes}),
r(sector, i, w) AS (SELECT DISTINCT sector, CAST(0 AS BIGINT), 0.0E0 FROM v UNION ALL
  SELECT r.sector, v.i, least(0.25E0, greatest(-0.25E0, r.w + v.delta)) FROM r JOIN v ON v.sector = r.sector AND v.i = r.i + 1)
SELECT sector, round(arg_max(w, i), 4) + 0.0 AS weight FROM r GROUP BY sector
""")
def _(t):
    f = merge.fold_feedback(t.votes)
    return f.select("sector", (F.round("weight", 4) + 0.0).alias("weight"))


_COUNTERS = """
WITH RECURSIVE v AS (SELECT source_id, (next = 1)::INT - (prev = 1)::INT AS da, (next = -1)::INT - (prev = -1)::INT AS dr, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS i FROM {votes}),
r(source_id, i, a, d) AS (SELECT DISTINCT source_id, CAST(0 AS BIGINT), 0, 0 FROM v UNION ALL
  SELECT r.source_id, v.i, greatest(0, r.a + v.da), greatest(0, r.d + v.dr) FROM r JOIN v ON v.source_id = r.source_id AND v.i = r.i + 1),
q AS (SELECT source_id, CAST(arg_max(a, i) AS BIGINT) AS approved, CAST(arg_max(d, i) AS BIGINT) AS rejected FROM r GROUP BY source_id)
"""


@query("feedback_counters", f"{_COUNTERS} SELECT * FROM q")
def _(t):
    return merge.feedback_counters(t.votes)


@query("source_quality", f"{_COUNTERS} SELECT source_id, CASE WHEN approved + rejected > 0 THEN CAST(floor(approved / (approved + rejected) * 100 + 0.5) AS BIGINT) END AS quality FROM q")
def _(t):
    return merge.source_quality(merge.feedback_counters(t.votes)).select("source_id", "quality")
