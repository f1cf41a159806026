"""Engine tables derived from the given tables.

Each binding is a list of SQL expressions that both engines read, so that the
input of a query and the input of its SQL twin are the same by construction.
``ARR(..)`` and ``TS_US(..)`` are spelled per engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"        # items, posts and the events table
AS_OF_SIGNALS = "2001-08-02 00:00:00"  # companies and their signals
AS_OF_US = 1_706_659_200_000_000
AS_OF_SIGNALS_US = 996_710_400_000_000
DAY_US = 86_400_000_000


def as_of_items():
    return F.timestamp_micros(F.lit(AS_OF_US))


def as_of_signals():
    return F.timestamp_micros(F.lit(AS_OF_SIGNALS_US))


_SECTOR = (
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'SaaS' WHEN 'FURNITURE' THEN 'D2C' "
    "WHEN 'HOUSEHOLD' THEN 'Marketplace' WHEN 'MACHINERY' THEN 'Exporter' ELSE 'Other' END"
)

# name -> (from clause, [(column, expression)])
BINDINGS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "items": (
        "documents",
        [
            ("item_id", "doc_id"),
            ("source_id", "source"),
            ("lang", "lang"),
            ("title", "regexp_replace(text, '(?s)\\n.*', '')"),
            ("summary", "text"),
            ("url", "concat('https://www.news.example.com/', lang, '/', md5(text), '?utm_source=', source, '&id=', CAST(n_chars AS STRING), '#top')"),
            ("published_us", f"CASE WHEN n_chars % 17 = 0 THEN NULL ELSE {AS_OF_US} - (doc_id % 90) * {DAY_US} - n_chars * 1000000 END"),
            ("fetched_us", f"{AS_OF_US} - (doc_id % 7) * {DAY_US}"),
        ],
    ),
    "companies": (
        "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
        [
            ("company_id", "c_custkey"),
            ("name", "c_name"),
            ("sector", _SECTOR),
            ("city", "n_name"),
            ("description", "concat('Sells ', lower(c_mktsegment), ' exports to ', n_name)"),
            ("website", "concat('https://www.c', CAST(c_custkey AS STRING), '.example.com/')"),
            ("domain", "concat('c', CAST(c_custkey AS STRING), '.example.com')"),
            ("size", "CASE WHEN c_acctbal > 9000 THEN 'enterprise' WHEN c_acctbal < 0 THEN 'unknown' ELSE 'startup' END"),
            ("in_region", "r_regionkey <> 0"),
            ("sells_intl", "CASE r_regionkey WHEN 0 THEN 'no' WHEN 1 THEN 'unknown' WHEN 2 THEN 'likely' ELSE 'yes' END"),
            ("markets", "CASE WHEN c_acctbal > 5000 THEN ARR(r_name, 'Global') WHEN c_acctbal > 0 THEN ARR(r_name, n_name) ELSE ARR('Global') END"),
            ("confidence", "CASE WHEN c_acctbal > 5000 THEN 0.8E0 WHEN c_acctbal > 0 THEN 0.6E0 ELSE 0.4E0 END"),
            ("status", "CASE WHEN c_acctbal < -500 THEN 'dismissed' WHEN c_acctbal < 0 THEN 'reviewed' WHEN c_acctbal > 8000 THEN 'qualified' ELSE 'new' END"),
            ("feedback", "CASE WHEN c_acctbal > 9000 THEN 1 WHEN c_acctbal < -500 THEN -1 ELSE 0 END"),
            ("first_seen_us", f"{AS_OF_SIGNALS_US} - (c_custkey % 40) * {DAY_US} + 3600000000"),
            ("enriched", "c_acctbal > 1000"),
            ("providers", "CASE WHEN c_acctbal > 3000 AND c_acctbal < 4000 THEN ARR('Stripe') WHEN c_acctbal > 4000 AND c_acctbal < 5000 THEN ARR('Razorpay', 'PayU') WHEN c_acctbal > 6000 AND c_acctbal < 6500 THEN ARR('Chargebee') ELSE ARR() END"),
            ("currencies", "CASE WHEN c_acctbal > 7000 THEN ARR('USD', 'INR') WHEN c_acctbal > 2000 THEN ARR('INR') ELSE ARR() END"),
            ("ships_abroad", "c_acctbal > 8500"),
            ("locales", "CASE WHEN c_acctbal > 9500 THEN 3 ELSE 0 END"),
            ("platform", "CASE WHEN c_acctbal > 5000 THEN 'Shopify' END"),
            # A stored score, for queries that only read it.
            ("stored_score", "CAST(floor(abs(c_acctbal) / 100) AS INT)"),
            ("last_event_us", f"{AS_OF_SIGNALS_US} - (c_custkey % 60) * {DAY_US} + c_nationkey * 60000000"),
            ("people_checked_us", f"CASE WHEN c_acctbal > 6000 THEN {AS_OF_SIGNALS_US} END"),
            ("why", "concat('likes ', lower(c_mktsegment))"),
        ],
    ),
    "signals": (
        "orders",
        [
            ("signal_id", "o_orderkey"),
            ("company_id", "o_custkey"),
            ("source_id", "concat('src', CAST(o_orderkey % 20 AS STRING))"),
            ("type", "CASE o_orderpriority WHEN '1-URGENT' THEN 'funding' WHEN '2-HIGH' THEN 'expansion' WHEN '3-MEDIUM' THEN 'launch' WHEN '5-LOW' THEN 'directory' ELSE 'pain' END"),
            ("stage", "CASE WHEN o_orderpriority = '5-LOW' THEN 'Seed' WHEN o_orderpriority <> '1-URGENT' THEN NULL WHEN o_orderstatus = 'F' THEN 'Seed' WHEN o_orderstatus = 'O' THEN 'Series A' ELSE 'Series D' END"),
            ("amount_usd_m", "CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 30000 THEN floor(o_totalprice / 100.0 + 0.5) / 100.0 WHEN o_orderpriority = '5-LOW' THEN 0.5E0 END"),
            ("title", "concat(o_orderpriority, ' order ', CAST(o_orderkey AS STRING), ' placed in ', CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) AS STRING))"),
            ("summary", "CASE WHEN o_totalprice > 480000 THEN 'Report mentions fraud and a shutdown overseas' WHEN o_totalprice > 300000 THEN 'Reaches international customers in Europe' ELSE 'Quiet week' END"),
            ("tags", "ARR(concat('status ', o_orderstatus), concat('priority ', o_orderpriority))"),
            ("competitors", "CASE WHEN o_totalprice > 470000 THEN ARR('Stripe') WHEN o_totalprice < 10000 THEN ARR('Razorpay') ELSE ARR() END"),
            ("corroborations", "1 + o_orderkey % 3"),
            ("confidence", "CASE WHEN o_orderstatus = 'F' THEN 0.8E0 ELSE 0.5E0 END"),
            ("url", "concat('https://news.example.com/o/', CAST(o_orderkey AS STRING))"),
            ("occurred_us", "epoch_us(o_orderdate)"),
            ("created_us", f"epoch_us(o_orderdate) + {DAY_US}"),
        ],
    ),
    # Headlines about companies, told from their orders.
    "headlines": (
        "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
        [
            ("item_id", "o_orderkey"),
            ("source_id", "concat('src', CAST(o_orderkey % 20 AS STRING))"),
            ("title", "CASE o_orderpriority "
             "WHEN '1-URGENT' THEN concat('Exclusive: ', c_name, ' raises $', CAST(CAST(floor(o_totalprice / 10000) AS BIGINT) AS STRING), ' Mn in Series ', CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE 'D' END, ' round') "
             "WHEN '2-HIGH' THEN concat(lower(c_mktsegment), ' startup ', c_name, ' expands to ', n_name, ' and Europe') "
             "WHEN '3-MEDIUM' THEN concat(c_name, ' launches export desk in Dubai') "
             "WHEN '5-LOW' THEN concat('Rs ', CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), ' Cr revenue at ', c_name, ' as sensex falls') "
             "ELSE concat('Why ', c_name, ' likes PayPal fees') END"),
            ("summary", "concat(CASE WHEN o_orderstatus = 'F' THEN 'Deal at Rs ' ELSE 'Deal at USD ' END, CAST(CAST(floor(o_totalprice / 3000) AS BIGINT) AS STRING), CASE WHEN o_orderstatus = 'F' THEN ' Cr valuation. ' ELSE ' Mn valuation. ' END, CASE WHEN o_orderstatus = 'P' THEN 'The deal of $' ELSE 'The round of $' END, CAST(CAST(floor(o_totalprice / 20000) AS BIGINT) AS STRING), CASE WHEN o_orderstatus = 'P' THEN ' million is near ' ELSE ' million was led by ' END, n_name, ' Partners. A team of ', CAST(CAST(floor(o_totalprice / 400) AS BIGINT) AS STRING), CASE WHEN o_totalprice > 300000 THEN ' people works in India.' ELSE ' people works there.' END)"),
            ("company_name", "c_name"),
            ("kind", "CASE WHEN o_orderstatus = 'P' THEN 'hits' ELSE 'rss' END"),
            ("category", "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'intel' ELSE 'leads' END"),
            ("assume_region", "o_orderstatus = 'O'"),
            ("published_us", "epoch_us(o_orderdate)"),
            ("url", "concat('https://www.news.example.com/o/', CAST(o_orderkey AS STRING), '/?utm_source=x')"),
        ],
    ),
    "intel": (
        "documents",
        [
            ("intel_id", "doc_id"),
            ("source_id", "source"),
            ("category", "CASE lang WHEN 'en' THEN 'market' WHEN 'fr' THEN 'regulatory' WHEN 'de' THEN 'competitor' ELSE 'voice' END"),
            ("title", "regexp_replace(text, '(?s)\n.*', '')"),
            ("advice", "concat('see ', source)"),
            ("topic", "CASE WHEN n_chars % 4 = 0 THEN NULL ELSE concat('topic', CAST(n_chars % 4 AS STRING)) END"),
            ("importance", "CAST(1 + n_chars % 3 AS INT)"),
            ("score", "CAST(n_chars % 101 AS INT)"),
            ("status", "CASE WHEN n_chars % 5 = 0 THEN 'replied' WHEN n_chars % 5 = 1 THEN 'lead' ELSE 'new' END"),
            ("item_status", "CASE WHEN n_chars % 7 = 0 THEN 'filtered' WHEN n_chars % 7 = 1 THEN 'dup' WHEN n_chars % 7 = 2 THEN 'new' ELSE 'done' END"),
            ("via", "CASE WHEN n_chars % 7 < 3 THEN NULL WHEN n_chars % 7 = 3 THEN 'structured' ELSE 'rules' END"),
            ("segment", "CASE WHEN n_chars % 6 = 0 THEN NULL ELSE concat('seg', CAST(n_chars % 6 AS STRING)) END"),
            ("intents", "CASE WHEN n_chars % 3 = 0 THEN ARR('fees', 'setup') WHEN n_chars % 3 = 1 THEN ARR('blocked') ELSE ARR() END"),
            ("published_us", f"CASE WHEN n_chars % 17 = 0 THEN NULL ELSE {AS_OF_US} - (doc_id % 40) * {DAY_US} - n_chars * 1000000 END"),
            ("created_us", f"{AS_OF_US} - (doc_id % 9) * 10800000000 - doc_id * 1000"),
        ],
    ),
    "sources": (
        "supplier",
        [
            ("source_id", "concat('src', CAST(s_suppkey AS STRING))"),
            ("name", "s_name"),
            ("enabled", "s_acctbal > 500"),
            ("category", "CASE WHEN s_nationkey < 8 THEN 'leads' WHEN s_nationkey < 16 THEN 'intel' ELSE 'voice' END"),
            ("created_by", "CASE WHEN s_nationkey > 12 THEN 'agent' ELSE 'system' END"),
            ("last_status", "CASE WHEN s_acctbal > 9000 THEN 'error' ELSE 'ok' END"),
            ("cadence_min", "60 + CAST(s_nationkey AS INT)"),
            ("min_cadence", "50"),
            ("max_cadence", "100"),
            ("leads_total", "CASE WHEN s_acctbal > 4000 THEN 1 ELSE 0 END"),
            ("extended", "s_nationkey > 20"),
            ("next_run_us", f"CASE WHEN s_nationkey = 3 THEN NULL ELSE {AS_OF_US} + CAST(floor(s_acctbal - 5000) AS BIGINT) * 1000000 END"),
            ("expires_us", f"{AS_OF_US} + CAST(floor(s_acctbal - 6000) AS BIGINT) * 1000000"),
        ],
    ),
    "runs": (
        "events",
        [
            ("run_id", "event_id"),
            ("source_id", "concat('src', CAST(user_id % 40 AS STRING))"),
            ("status", "CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END"),
            ("new_items", "CASE WHEN user_id % 40 < 10 THEN 0 ELSE CAST(floor(value) AS INT) END"),
        ],
    ),
    # Pages with a storefront footer appended.
    "sites": (
        "pages",
        [
            ("page_id", "page_id"),
            ("url", "url"),
            ("html", "concat(html, "
             "CASE WHEN page_id % 3 = 0 THEN '<script src=\"https://js.stripe.com/v3\"></script>' WHEN page_id % 5 = 0 THEN '<script src=\"https://checkout.razorpay.com/v1\"></script><link rel=\"x\" href=\"https://cdn.shopify.com/a.css\">' ELSE '' END, "
             "CASE WHEN page_id % 2 = 0 THEN '<p>Plans from $ 20 or EUR 18. We ship worldwide. Write to sales@shop.example.com or HELLO@shop.example.com</p>' ELSE '<p>Rs 500 only</p>' END, "
             "'<link rel=\"alternate\" hreflang=\"en\"><link rel=\"alternate\" hreflang=\"fr\"><a href=\"/about?x=1\">About us</a><a href=\"/our-team\">Team</a><a href=\"/pricing\">Pricing</a>', "
             "'<a href=\"https://www.linkedin.com/company/acme', CAST(page_id AS STRING), '?src=site\">in</a>', "
             "CASE WHEN page_id % 4 = 0 THEN concat('<a href=\"https://boards.greenhouse.io/acme', CAST(page_id AS STRING), '\">Jobs</a>') WHEN page_id % 4 = 1 THEN '<a href=\"https://jobs.lever.co/lever-co\">Jobs</a>' ELSE '' END, "
             "CASE WHEN page_id % 7 = 0 THEN '<p>This domain may be for sale</p>' ELSE '' END, "
             "concat('<script type=\"application/ld+json\">{\"@graph\": [{\"founder\": [{\"name\": \"Asha Rao\"}], \"numberOfEmployees\": {\"value\": ', CAST(page_id + 2 AS STRING), '}}]}</script></body>'))"),
        ],
    ),
    # Search traffic per supplier, told from its sales.
    "traffic": (
        "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
        [
            ("company_id", "l_suppkey"),
            ("country", "n_name"),
            ("language", "l_returnflag"),
            ("etv", "l_extendedprice"),
            ("keywords", "l_quantity"),
            ("paid_count", "CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END"),
            ("part_id", "l_partkey"),
            ("shipped_us", "epoch_us(l_shipdate)"),
        ],
    ),
    "posts": (
        "conversations",
        [
            ("post_id", "conv_id * 1000 + turn"),
            ("channel", "role"),
            ("comment", "turn > 0"),
            ("title", "regexp_replace(text, '(?s)\\n.*', '')"),
            ("body", "text"),
            ("published_us", f"{AS_OF_US} - (conv_id % 30) * {DAY_US} - turn * 3600000000"),
            ("status", "CASE WHEN turn = 0 THEN 'new' WHEN turn = 1 THEN 'replied' WHEN turn = 2 THEN 'lead' ELSE 'ignored' END"),
        ],
    ),
    # Threads about getting paid, told from orders.
    "threads": (
        "orders JOIN customer ON o_custkey = c_custkey",
        [
            ("post_id", "o_orderkey"),
            ("channel", "CASE WHEN o_orderkey % 3 = 0 THEN 'indiatax' ELSE lower(c_mktsegment) END"),
            ("comment", "o_orderstatus = 'P'"),
            ("title", "CASE o_orderpriority WHEN '1-URGENT' THEN 'PayPal froze my account, which alternative?' WHEN '2-HIGH' THEN 'How to receive international payments' "
             "WHEN '3-MEDIUM' THEN 'Feedback wanted on my app' WHEN '5-LOW' THEN 'Weekend plans' ELSE concat('Swift fees for ', c_name) END"),
            ("body", "concat(CASE WHEN c_acctbal > 5000 THEN 'We are an Indian saas startup. ' WHEN c_acctbal > 2000 THEN 'I sell handicraft abroad from Jaipur! ' ELSE 'Just asking. ' END, "
             "CASE WHEN o_orderstatus = 'F' THEN 'Our foreign clients pay by swift and Stripe is stuck? ' WHEN o_orderstatus = 'O' THEN 'Wise and  Lemon Squeezy take a 3% fee. ' ELSE 'Nothing new here. ' END, "
             "CASE WHEN o_totalprice > 400000 THEN 'Need it asap. Crypto maybe.' WHEN o_totalprice < 50000 THEN 'My credit card was declined on a trip.' ELSE 'Thanks' END)"),
            ("published_us", f"{AS_OF_SIGNALS_US} - (o_orderkey % 40) * {DAY_US}"),
            ("status", "CASE o_orderstatus WHEN 'F' THEN 'new' WHEN 'O' THEN 'replied' ELSE 'lead' END"),
        ],
    ),
    # One row per vote: labels as feedback on the item's source.
    "votes": (
        "labels JOIN documents USING (doc_id)",
        [
            ("seq", "doc_id"),
            ("company_id", "doc_id"),
            ("sector", "lang"),
            ("source_id", "source"),
            ("prev", "CASE WHEN n_chars % 5 = 0 THEN -1 WHEN n_chars % 5 = 1 THEN 1 ELSE 0 END"),
            ("next", "CAST(quality AS INT) - CAST(toxic AS INT)"),
        ],
    ),
}



def _spark(sql: str) -> str:
    return (
        sql.replace("ARR()", "CAST(array() AS ARRAY<STRING>)").replace("ARR(", "array(")
        .replace("epoch_us(", "unix_micros_ntz(")
    )


def _fix_epoch(sql: str) -> str:
    return re.sub(r"unix_micros_ntz\((\w+)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))", sql)


def _duck(sql: str) -> str:
    return sql.replace("ARR()", "CAST([] AS VARCHAR[])").replace("ARR(", "list_value(").replace("AS STRING)", "AS VARCHAR)")


def bind(tables, name: str) -> DataFrame:
    """The binding as a DataFrame; Catalyst prunes the columns a query does not use."""
    source, columns = BINDINGS[name]
    parts = re.split(r"\s+JOIN\s+", source)
    df = tables.raw(parts[0])
    for part in parts[1:]:
        m = re.match(r"(\w+)\s+(ON|USING)\s+(.*)", part)
        right = tables.raw(m.group(1))
        if m.group(2) == "USING":
            df = df.join(right, m.group(3).strip("() "))
        else:
            df = df.join(right, F.expr(m.group(3)))
    out = df.selectExpr(*[f"{_fix_epoch(_spark(e)).replace(chr(92) + 'n', chr(92) * 2 + 'n')} AS {c}" for c, e in columns])
    for c in [c for c, _ in columns if c.endswith("_us")]:
        out = out.withColumn(c[:-3] + "_at", F.timestamp_micros(c))
    return out


def cte(name: str) -> str:
    source, columns = BINDINGS[name]
    cols = ", ".join(f"{_duck(e)} AS {c}" for c, e in columns)
    return f"{name} AS (SELECT {cols} FROM {source})"


def with_bindings(sql: str) -> str:
    """Prefix the twin with the bindings it names as ``{items}`` and so on."""
    used = []
    for name in BINDINGS:
        if "{" + name + "}" in sql:
            used.append(cte(name))
            sql = sql.replace("{" + name + "}", name)
    sql = sql.strip()
    if not used:
        return sql
    if re.match(r"(?i)with\s+recursive\b", sql):
        return "WITH RECURSIVE " + ", ".join(used) + ", " + re.sub(r"(?i)^with\s+recursive\s+", "", sql)
    if re.match(r"(?i)with\b", sql):
        return "WITH " + ", ".join(used) + ", " + re.sub(r"(?i)^with\s+", "", sql)
    return "WITH " + ", ".join(used) + " " + sql
