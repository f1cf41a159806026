"""Gates, story classifier and post classifier."""

from pyspark.sql import functions as F

from ..functions import fixed_packs as fp
from ..functions import fixed_values as fv
from ..functions.packs import rule_hits
from ..functions.regex import phrases, words
from ..operators import gates, intel, voice
from ..operators.state import once
from .bindings import AS_OF_SIGNALS_US, AS_OF_US, DAY_US, as_of_items, as_of_signals
from .registry import query


def re_sql(expr, pattern):
    return f"regexp_matches({expr}, '(?i)" + pattern.replace("'", "''") + "')"


def case_labels(expr, table, default):
    d = "NULL" if default is None else f"'{default}'"
    return "CASE " + " ".join(f"WHEN {re_sql(expr, p)} THEN '{k}'" for k, p in table.items()) + f" ELSE {d} END"


_TEXT = "(title || ' ' || coalesce(summary, ''))"
_HITS = ", ".join(f"{re_sql(_TEXT, p)} AS h_{k}" for k, p in fp.GATE_RULES.items())


@query("rule_hits", "SELECT item_id, " + " || ".join(f"CASE WHEN h_{k} THEN '1' ELSE '0' END" for k in fp.GATE_RULES) + f" AS bits FROM (SELECT item_id, {_HITS} FROM {{headlines}})")
def _(t):
    h = t.headlines.select("item_id", rule_hits(gates.item_text(F.col("title"), F.col("summary")), gates.GATE_PACK).alias("h"))
    bits = F.concat(*[F.when(F.col("h")[k], "1").otherwise("0") for k in fp.GATE_RULES])
    return h.select("item_id", bits.alias("bits"))


_INTEL_CTE = f"""
v AS (SELECT *, CASE
   WHEN {re_sql('title', '|'.join(f'(?:{n})' for n in fp.INTEL_NOISE))} AND NOT {re_sql('title', fp.INTEL_NOISE_EXCEPT)} THEN NULL
   WHEN {re_sql('title', fp.IMPORT_ONLY)} AND NOT {re_sql(_TEXT, fp.IMPORT_EXCEPT)} THEN NULL
   WHEN {re_sql('title', phrases(fv.COMPETITORS))} AND {re_sql('title', fp.COMPETITOR_STORY)} THEN 'competitor/2/competitor'
   WHEN NOT {re_sql(_TEXT, fp.INTEL_REGION)} THEN NULL
   {' '.join(f"WHEN {re_sql('title', p)} THEN '{c}/{i}/{k}'" for k, c, i, p in fp.TOPICS)} END AS verdict FROM {{headlines}})
"""


@query("classify_intel", f"WITH {_INTEL_CTE} SELECT item_id, verdict FROM v WHERE verdict IS NOT NULL")
def _(t):
    v = intel.classify_intel(t.headlines)
    return v.select("item_id", F.concat_ws("/", "verdict.category", F.col("verdict.importance").cast("string"), "verdict.topic").alias("verdict"))


@query("competitor_action", f"SELECT item_id, {case_labels('title', fp.COMPETITOR_ACTIONS, 'other')} AS action FROM {{headlines}} WHERE {re_sql('title', phrases(fv.COMPETITORS))}")
def _(t):
    from ..functions.regex import matches

    h = t.headlines.where(matches(F.col("title"), phrases(fv.COMPETITORS)))
    return h.select("item_id", intel.competitor_action(F.col("title")).alias("action"))


JUDGED = f"""
WITH {_INTEL_CTE},
h AS (SELECT *, {_HITS} FROM v),
r AS (SELECT item_id, category, title, company_name, verdict, CASE
  WHEN category = 'intel' THEN CASE WHEN verdict IS NULL THEN 'no relevant topic' END
  WHEN h_noise AND NOT h_funding THEN 'market noise'
  WHEN NOT (h_funding OR h_expansion OR h_launch OR h_pain) THEN 'no funding, expansion or launch signal'
  WHEN NOT (h_region OR (kind <> 'hn' AND assume_region)) THEN 'no region signal' END AS reason FROM h)
"""
_PREFILTER = JUDGED + """
SELECT coalesce(CASE WHEN reason IS NULL THEN category END, 'dropped') AS route, coalesce(reason, '') AS reason, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY ALL
"""


@query("prefilter", _PREFILTER)
def _(t):
    v = intel.classify_intel(t.headlines, keep_all=True).withColumn("intel_pass", F.col("verdict").isNotNull())
    p = gates.prefilter(v)
    return p.groupBy(F.coalesce("route", F.lit("dropped")).alias("route"), F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query("age_gate", f"SELECT item_id FROM {{items}} WHERE published_us IS NULL OR ({AS_OF_US} - published_us) / 86400000000.0 <= 45")
def _(t):
    return gates.age_gate(t.items, as_of_items()).select("item_id")


@query("must_match", f"SELECT item_id FROM {{items}} WHERE CASE source_id WHEN 'src0' THEN {re_sql(_TEXT, words(['the', 'und']))} WHEN 'src1' THEN {re_sql(_TEXT, words(['que']))} ELSE TRUE END")
def _(t):
    return gates.must_match(t.items, {"src0": words(["the", "und"]), "src1": words(["que"])}).select("item_id")


@query("drop_incomplete", "SELECT item_id FROM {items} WHERE url <> '' AND title <> ''")
def _(t):
    return gates.drop_incomplete(t.items).select("item_id")


@query("min_confidence", "SELECT signal_id FROM {signals} WHERE coalesce(confidence, 1) >= 0.6")
def _(t):
    return gates.min_confidence(t.signals, 0.6).select("signal_id")


_NORM_TMPL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\.(com|in|ai|io|co|app|tech)\b', '', 'g'), '[''’]s\b', '', 'g'), '"
    + words(fv.NAME_SUFFIXES) + r"', ' ', 'g'), '[^a-z0-9]+', '', 'g')"
)


def norm_sql(expr):
    return _NORM_TMPL.format(expr)




@query("valid_name", f"""
SELECT p_partkey, p_name FROM part
WHERE length(trim(p_name)) BETWEEN 2 AND 60 AND lower(trim(p_name)) NOT IN ('red ring', 'blue bolt') AND {norm_sql('p_name')} <> ''
""")
def _(t):
    return t.part.where(gates.valid_name(F.col("p_name"), ["Red Ring", "Blue Bolt"], ["Stripe"])).select("p_partkey", "p_name")


_HEAD = "regexp_extract(title, '^(.{0,60}?) (raises|expands|launches|order|revenue|likes)\\b', 1)"


@query("plausible_name", f"""
SELECT item_id FROM (SELECT item_id, {_HEAD} AS name FROM {{headlines}})
WHERE length(name) BETWEEN 2 AND 40 AND regexp_matches(name, '^[A-Za-z0-9]') AND len(string_split_regex(name, '\\s+')) <= 4
 AND NOT (regexp_matches(name, '^[a-z]') AND NOT regexp_matches(name, '[A-Z]'))
 AND NOT ({re_sql('name', words([fp.GENERIC_NAME_WORDS]))} AND len(string_split_regex(name, '\\s+')) > 1)
 AND NOT {re_sql('name', words([fp.ROLE_NAME_WORDS]))}
""")
def _(t):
    h = once(t.headlines.select("item_id", "title"), name=F.regexp_extract("title", r"^(.{0,60}?) (raises|expands|launches|order|revenue|likes)\b", 1))
    return h.where(gates.plausible_name(F.col("name"))).select("item_id")


@query("flag_enterprise", """
SELECT p_partkey, (lower(p_name) LIKE 'red%' OR lower(p_name) = 'hot' OR lower(p_name) LIKE 'hot %' OR lower(p_name) LIKE 'blue gear%') AND NOT (lower(p_name) LIKE 'red%' AND NOT (lower(p_name) = 'red' OR lower(p_name) LIKE 'red %')) AS enterprise FROM part
""")
def _(t):
    return gates.flag_enterprise(t.part.withColumnRenamed("p_name", "name"), ["Red", "Hot", "Blue Gear"]).select("p_partkey", "enterprise")


_POST_TEXT = "(title || ' ' || body)"
_SENT = r"list_filter(string_split(regexp_replace(regexp_replace(txt, '([.?!])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: " + re_sql("s", fp.POST_CORE) + ")"
_VOICE = f"""
f AS (SELECT *, title || CASE WHEN len(sent) > 0 THEN ' ' || array_to_string(sent, ' ') ELSE ' ' END AS focus FROM (SELECT *, {_SENT} AS sent FROM (SELECT *, {_POST_TEXT} AS txt FROM {{threads}}))),
g AS (SELECT *, {re_sql('focus', fp.POST_RECEIVE)} AND NOT {re_sql('txt', fp.POST_NO_RECEIVE)} AS receive, {re_sql('txt', fp.POST_BUSINESS)} AS business FROM f),
k AS (SELECT * FROM g WHERE NOT {re_sql('title', fp.POST_OFFTOPIC)} AND NOT {re_sql('substr(txt, 1, 400)', fp.POST_OFFTOPIC)} AND NOT {re_sql('title', fp.POST_PROMO_TITLE)}
  AND NOT {re_sql('title', fp.POST_CONSUMER)} AND ({re_sql('channel', fp.POST_REGION_CHANNELS)} OR {re_sql('txt', fp.POST_REGION)})
  AND ({re_sql('title', fp.POST_CORE)} OR len(regexp_extract_all(txt, '(?i){fp.POST_CORE}')) >= CASE WHEN comment THEN 1 ELSE 2 END)
  AND (receive OR {re_sql('focus', fp.POST_CROSS_BORDER)}) AND (receive OR business) AND NOT ({re_sql('focus', fp.POST_CONSUMER)} AND NOT receive))
"""


@query("voice_gate", f"WITH {_VOICE} SELECT post_id FROM k")
def _(t):
    return voice.voice_gate(t.threads).where("voice_pass").select("post_id")


_INTENTS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {re_sql('focus', p)} THEN '{k}' END" for k, p in fp.POST_INTENTS.items()) + "], lambda x: x IS NOT NULL)"
_PROV = "list_transform(regexp_extract_all(lower(txt), '" + words(fp.POST_PROVIDERS) + "'), lambda p: regexp_replace(p, '\\s+', ' ', 'g'))"
_TAGS = f"""
{_VOICE},
t1 AS (SELECT *, {_INTENTS_SQL} AS ri, list_sort(list_distinct({_PROV})) AS providers FROM k),
t2 AS (SELECT *, len(providers) > 0 AND {re_sql('focus', fp.POST_UNHAPPY)} AS unhappy,
  coalesce({case_labels('focus', fp.POST_SEGMENTS, None)}, {case_labels('txt', fp.POST_SEGMENTS, None)}, 'other') AS segment FROM t1),
t3 AS (SELECT *, coalesce(ri[1], 'discussion') AS intent,
  CASE WHEN {re_sql('focus', fp.POST_FIT_CARDS[1])} AND {re_sql('focus', fp.POST_FIT_ACCOUNTS[1])} THEN 'MCA + IPG' WHEN {re_sql('focus', fp.POST_FIT_CARDS[1])} THEN 'IPG'
    WHEN {re_sql('focus', fp.POST_FIT_ACCOUNTS[1])} THEN 'MCA' WHEN segment = 'saas' THEN 'IPG + recurring' WHEN segment = 'ecommerce' THEN 'IPG' WHEN segment IN ('goods', 'services') THEN 'MCA' END AS fit,
  nullif(regexp_extract(txt, '(?i){fp.POST_RESTRICTED}'), '') AS restricted FROM t2)
"""


@query("voice_tags", f"WITH {_TAGS} SELECT post_id, array_to_string(ri, ';') || CASE WHEN unhappy THEN ';provider-complaint' ELSE '' END AS intents, intent, segment, fit, array_to_string(providers, ';') AS providers, restricted FROM t3")
def _(t):
    d = voice.voice_tags(voice.voice_gate(t.threads).where("voice_pass"))
    suffix = F.when(F.col("unhappy"), ";provider-complaint").otherwise("")
    return d.select(
        "post_id", F.concat(F.array_join("rule_intents", ";"), suffix).alias("intents"), "intent", "segment", "fit",
        F.array_join(F.array_sort("providers"), ";").alias("providers"), "restricted")


SCORED_SQL = f"""
{_TAGS},
s AS (SELECT *, least(100, greatest(0,
  CASE WHEN list_contains(ri, 'switching') THEN 25 ELSE 0 END + CASE WHEN business OR receive THEN 20 ELSE 0 END
  + CASE WHEN list_has_any(ri, ['blocked', 'fees', 'compliance']) OR {re_sql('focus', fp.POST_PROBLEM)} THEN 20 ELSE 0 END
  + CASE WHEN receive OR {re_sql('txt', fp.POST_REVENUE_ABROAD)} THEN 15 ELSE 0 END + CASE WHEN unhappy THEN 10 ELSE 0 END
  + CASE WHEN {re_sql('txt', fp.POST_URGENT)} THEN 10 ELSE 0 END
  + CASE WHEN ({AS_OF_SIGNALS_US} - published_us) / 86400000000.0 > 21 THEN -10 ELSE 0 END)) AS score FROM t3),
scored AS (SELECT *, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'research' ELSE 'monitor' END AS band FROM s)
"""


@query("score_voice", f"WITH {SCORED_SQL} SELECT post_id, CAST(score AS BIGINT) AS score, band FROM scored")
def _(t):
    d = voice.classify_voice(t.threads, as_of_signals())
    return d.select("post_id", F.col("score").cast("bigint").alias("score"), "band")
