"""Text operators over documents, pages and headlines."""

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.numeric import round_half_up
from ..functions.packs import RulePack, detect_labels, guess_label
from ..functions.regex import words
from .registry import query

_CANON = r"""
regexp_replace(
  regexp_replace(
    regexp_replace(
      regexp_replace(
        regexp_replace(lower(regexp_extract(url, '^[a-z]+://[^/]+')) || regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '#.*$', ''),
          '^(https?://)www\.', '\1'),
        '([?&])((utm_|fbclid|gclid|ref_src|mc_|igshid)[^&=]*|ref|oc)(=[^&]*)?', '\1', 'g'),
      '([?&])&+', '\1', 'g'),
    '[?&]$', ''),
  '/$', '')
"""


@query("canonical_url", f"SELECT page_id, {_CANON} AS canonical FROM pages")
def _(t):
    return t.pages.select("page_id", tx.canonical_url(F.col("url")).alias("canonical"))


@query("url_key", f"SELECT page_id, sha1({_CANON}) AS url_key FROM pages")
def _(t):
    return t.pages.select("page_id", tx.url_key(F.col("url")).alias("url_key"))


@query("domain_of", r"""
SELECT page_id, CASE WHEN h LIKE '%.%' THEN h END AS domain FROM (
  SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS h FROM pages)
""")
def _(t):
    return t.pages.select("page_id", tx.domain_of(F.col("url")).alias("domain"))


@query("strip_markup", r"""
SELECT page_id, sha1(s) AS text_sha, CAST(length(s) AS BIGINT) AS n_chars FROM (
 SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(
   regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
   '&nbsp;', ' '), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g')) AS s FROM pages)
""")
def _(t):
    s = tx.strip_markup(F.col("html"))
    return t.pages.select("page_id", s.alias("s")).select(
        "page_id", F.sha1("s").alias("text_sha"), F.length("s").cast("bigint").alias("n_chars"))


@query("clip_text", r"""
SELECT doc_id, CASE WHEN length(text) > 120 THEN regexp_replace(substr(text, 1, 119), '\s+$', '') || '…' ELSE text END AS clipped
FROM documents
""")
def _(t):
    return t.documents.select("doc_id", tx.clip_text(F.col("text"), 120).alias("clipped"))


_NORM = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\.(com|in|ai|io|co|app|tech)\b', '', 'g'), '[''’]s\b', '', 'g'), '"
    + words(fv.NAME_SUFFIXES) + r"', ' ', 'g'), '[^a-z0-9]+', '', 'g')"
)
_NAME_SQL = "concat('The ', p_name, '''s ', p_type, CASE WHEN p_size > 25 THEN ' Labs Pvt. Ltd.' ELSE '.com Technologies' END)"


@query("norm_name", f"SELECT p_partkey, {_NORM.format(_NAME_SQL)} AS norm FROM part")
def _(t):
    return t.part.select("p_partkey", tx.norm_name(F.expr(_NAME_SQL.replace("'''s '", "'\\'s '"))).alias("norm"))


def _sql_tokens(expr, junk, min_len, stop):
    lst = ", ".join(f"'{w}'" for w in stop)
    return f"list_filter(string_split_regex(regexp_replace(lower({expr}), '{junk}', ' ', 'g'), ' +'), lambda w: length(w) >= {min_len} AND w NOT IN ({lst}))"


SQL_ITEM_TOKENS = _sql_tokens("title", "[^a-z0-9₹$ ]+", 2, fv.ITEM_STOPWORDS)
SQL_STORY_TOKENS = _sql_tokens("title", "[^a-z0-9]+", 3, fv.STORY_STOPWORDS)


@query("token_set", f"""
SELECT item_id, CAST(length(tl) AS BIGINT) AS n_tokens, array_to_string(list_sort(list_distinct(tl)), ' ') AS tokens
FROM (SELECT item_id, {SQL_ITEM_TOKENS} AS tl FROM {{items}})
""")
def _(t):
    return t.items.select("item_id", tx.token_list(F.col("title")).alias("tl")).select(
        "item_id", F.size("tl").cast("bigint").alias("n_tokens"),
        F.array_join(F.array_sort(F.array_distinct("tl")), " ").alias("tokens"))


@query("title_tokens", f"""
SELECT item_id, array_to_string(list_sort(list_distinct({SQL_STORY_TOKENS})), ' ') AS tokens FROM {{items}}
""")
def _(t):
    return t.items.select("item_id", F.array_join(tx.title_tokens(F.col("title")), " ").alias("tokens"))


SQL_MONEY = r"""
CASE WHEN sym <> '' THEN try_cast(num1 AS DOUBLE) ELSE try_cast(num2 AS DOUBLE) END *
CASE WHEN u IN ('mn','million','m') THEN 1e6 WHEN u IN ('bn','billion','b') THEN 1e9 WHEN u LIKE 'cr%' THEN 1e7 WHEN u LIKE 'lakh%' THEN 1e5 WHEN u IN ('k','thousand') THEN 1e3 ELSE 1.0 END
"""


def sql_money(source, key, expr):
    """Twin of parse_money over ``expr``: select key, usd_m."""
    a, b = "(?i)" + fv.MONEY_WITH_SYMBOL, "(?i)" + fv.MONEY_BY_UNIT
    return f"""
    SELECT {key}, CASE WHEN m > 0.005 AND m < 20000 THEN floor(m * 100.0 + 0.5) / 100.0 END AS usd_m FROM (
      SELECT {key}, CASE WHEN (sym <> '' AND regexp_matches(sym, '(?i)₹|INR|Rs')) OR (sym = '' AND regexp_matches(u || tail, 'cr|lakh|rupee|inr')) THEN v / 85.0 ELSE v END / 1e6 AS m FROM (
        SELECT {key}, sym, u, tail, {SQL_MONEY} AS v FROM (
          SELECT {key}, sym, num1, num2, tail, lower(CASE WHEN sym <> '' THEN u1 ELSE u2 END) AS u FROM (
            SELECT {key}, regexp_extract(s, '{a}', 1) AS sym, regexp_extract(s, '{a}', 2) AS num1, regexp_extract(s, '{a}', 3) AS u1,
              regexp_extract(s, '{b}', 1) AS num2, regexp_extract(s, '{b}', 2) AS u2, lower(regexp_extract(s, '{b}', 3)) AS tail
            FROM (SELECT {key}, replace(coalesce({expr}, ''), ',', '') AS s FROM {source})))))"""


@query("parse_money", sql_money("{headlines}", "item_id", "title"))
def _(t):
    return t.headlines.select("item_id", tx.parse_money(F.col("title")).alias("usd_m"))


@query("raise_amount", r"""
SELECT item_id, nullif(trim(regexp_extract(s, '(?i)(US\$|USD|\$|₹|INR|Rs\.?)\s?[\d.,]+\s?(mn|million|m\b|cr\b|crore|bn|billion|b\b|lakh|k\b)?')), '') AS amount_text
FROM (SELECT item_id, regexp_replace(regexp_replace(title || '. ' || summary,
   '(?i)(\bat|valuation of|valued at|revenue of|turnover of|revenue to|worth)\s+(a\s+)?(US\$|USD|\$|₹|INR|Rs\.?)\s?[\d.,]+', 'x', 'g'),
   '(?i)(US\$|USD|\$|₹|INR|Rs\.?)\s?[\d.,]+\s?(mn|million|cr\b|crore)?[^$]{0,9}valuation', 'x', 'g') AS s FROM {headlines})
""")
def _(t):
    return t.headlines.select(
        "item_id", tx.raise_amount(F.concat(F.col("title"), F.lit(". "), F.col("summary"))).alias("amount_text"))


@query("format_money", r"""
SELECT signal_id, CASE WHEN x >= 1000 THEN '$' || printf('%.1f', x / 1000) || 'B' WHEN x >= 10 THEN '$' || printf('%.0f', x) || 'M'
  WHEN x >= 1 THEN '$' || printf('%.1f', x) || 'M' ELSE '$' || CAST(CAST(floor(x * 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'K' END AS display
FROM (SELECT signal_id, floor(amount_usd_m) + 0.2 AS x FROM {signals} WHERE amount_usd_m IS NOT NULL
      UNION ALL SELECT signal_id, floor(amount_usd_m) * 100 + 30 AS x FROM {signals} WHERE amount_usd_m > 10)
""")
def _(t):
    s = t.signals.where("amount_usd_m IS NOT NULL")
    x = s.select("signal_id", (F.floor("amount_usd_m") + F.lit(0.2)).alias("x")).unionByName(
        s.where("amount_usd_m > 10").select("signal_id", (F.floor("amount_usd_m") * F.lit(100.0) + F.lit(30.0)).alias("x")))
    return x.select("signal_id", tx.format_money(F.col("x")).alias("display"))


_STAGE_SQL = """
CASE WHEN v IN ('pre-seed', 'pre seed') THEN 'Pre-Seed' WHEN v = 'pre-ipo' THEN 'Pre-IPO'
  WHEN v IN ('angel', 'seed', 'bridge', 'debt', 'grant') THEN upper(substr(v, 1, 1)) || substr(v, 2)
  WHEN v LIKE 'pre-series %' THEN 'Pre-Series ' || upper(right(v, 1)) WHEN v LIKE 'series %' THEN 'Series ' || upper(right(v, 1)) END
"""


@query("norm_stage", f"""
SELECT item_id, {_STAGE_SQL} AS stage FROM (SELECT item_id, lower(regexp_extract(title, '(?i){fv.STAGE_PATTERN}', 1)) AS v FROM {{headlines}})
""")
def _(t):
    return t.headlines.select("item_id", tx.norm_stage(F.col("title")).alias("stage"))


# A small pack over words that do occur in the documents.
DOC_TOPICS = {
    "law": r"\b(of the|und der|de la)\b",
    "trade": r"\b(tion|with|von|para)\b",
    "food": r"\b(the|les|das)\b",
}
DOC_PACK = RulePack.of(DOC_TOPICS)
_LOW = "lower(summary)"
SQL_GUESS = "CASE " + " ".join(f"WHEN regexp_matches({_LOW}, '{p}') THEN '{k}'" for k, p in DOC_TOPICS.items()) + " ELSE 'Other' END"
SQL_DETECT = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_LOW}, '{p}') THEN '{k}' END" for k, p in DOC_TOPICS.items()) + "], lambda x: x IS NOT NULL)"


@query("guess_label", f"SELECT item_id, {SQL_GUESS} AS label FROM {{items}}")
def _(t):
    return t.items.select("item_id", guess_label(F.lower("summary"), DOC_PACK).alias("label"))


@query("detect_labels", f"SELECT item_id, array_to_string({SQL_DETECT}, ';') AS labels FROM {{items}}")
def _(t):
    return t.items.select("item_id", F.array_join(detect_labels(F.lower("summary"), DOC_PACK), ";").alias("labels"))


@query("strip_own_name", """
SELECT item_id, replace(title, company_name, ' ') AS without_name FROM {headlines}
""")
def _(t):
    return t.headlines.select("item_id", tx.strip_own_name(F.col("title"), F.col("company_name")).alias("without_name"))


@query("evidence_sentence", r"""
SELECT item_id, nullif(trim(regexp_extract(title || '. ' || summary, '[^.]*led by[^.]*\.?')), '') AS evidence FROM {headlines}
""")
def _(t):
    return t.headlines.select(
        "item_id",
        tx.evidence_sentence(F.concat("title", F.lit(". "), "summary"), "led by").alias("evidence"))


@query("set_similarity", f"""
WITH p AS (SELECT item_id, list_sort(list_distinct({SQL_ITEM_TOKENS})) AS a FROM {{items}}),
     q AS (SELECT item_id, list_sort(list_distinct({_sql_tokens("summary", "[^a-z0-9₹$ ]+", 2, fv.ITEM_STOPWORDS)})) AS b FROM {{items}})
SELECT item_id, CAST(floor(1000 * CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END + 0.5) AS BIGINT) AS jaccard_pm,
  CAST(floor(1000 * CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / least(len(a), len(b)) END + 0.5) AS BIGINT) AS overlap_pm
FROM p JOIN q USING (item_id)
""")
def _(t):
    d = t.items.select("item_id", tx.token_set(F.col("title")).alias("a"), tx.token_set(F.col("summary")).alias("b"))
    return d.select(
        "item_id",
        round_half_up(tx.jaccard(F.col("a"), F.col("b")) * 1000).alias("jaccard_pm"),
        round_half_up(tx.overlap_coefficient(F.col("a"), F.col("b")) * 1000).alias("overlap_pm"))
