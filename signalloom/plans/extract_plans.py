"""Landing, extraction, people, sites and traffic over the given tables."""

from pyspark.sql import functions as F

from ..functions import fixed_packs as fp
from ..functions import fixed_values as fv
from ..operators import extract, intel, merge, people, ranking, sites, traction
from ..operators.state import cut
from ..sources import feeds, sinks
from .bindings import AS_OF_SIGNALS_US, AS_OF_US, DAY_US, as_of_items, as_of_signals
from .gate_plans import case_labels, norm_sql, re_sql
from .registry import query
from .score_plans import scored_companies

# ---------------------------------------------------------------- landing
_XML_TITLE = "regexp_replace(title, '[&<>#%*]', '')"


def _bodies(t):
    """One feed body per source and language: RSS, Atom or RDF by language."""
    i = t.items.select("source_id", "lang", "item_id", F.regexp_replace("title", "[^A-Za-z .]", "").alias("title"), "published_at")
    day = F.date_format(F.coalesce("published_at", F.lit("2024-01-02").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rss = F.concat(F.lit("<item><title>"), "title", F.lit("</title><link>https://n.example.com/"), "item_id", F.lit("</link><description>&lt;b&gt;Hi&lt;/b&gt; there</description><pubDate>"), day, F.lit("</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title>"), "title", F.lit("</title><link rel='alternate' href='https://n.example.com/"), "item_id", F.lit("'/><id>x</id><summary>Hi there</summary><updated>"), day, F.lit("</updated></entry>"))
    one = i.select("source_id", "lang", F.when(F.col("lang") == "fr", atom).otherwise(rss).alias("x"), F.floor(F.col("item_id") / 50).alias("page"))
    # Feeds are pages of at most 50 entries.
    joined = one.groupBy("source_id", "lang", "page").agg(F.array_join(F.collect_list("x"), "").alias("x"))
    body = (
        F.when(F.col("lang") == "en", F.concat(F.lit("<rss version='2.0'><channel><title>t</title>"), "x", F.lit("</channel></rss>")))
        .when(F.col("lang") == "fr", F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'>"), "x", F.lit("</feed>")))
        .when(F.col("lang") == "de", F.concat(F.lit("<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'>"), F.regexp_replace(F.regexp_replace("x", "<pubDate>", "<dc:date>"), "</pubDate>", "</dc:date>"), F.lit("</rdf:RDF>")))
        .otherwise(F.lit("not a feed")))
    return joined.select("source_id", F.timestamp_micros(F.lit(AS_OF_US)).alias("fetched_at"), body.alias("body"))


@query("land_feeds", r"""
SELECT source_id, 'https://n.example.com/' || CAST(item_id AS VARCHAR) AS url, trim(regexp_replace(regexp_replace(title, '[^A-Za-z .]', '', 'g'), '\s+', ' ', 'g')) AS title, 'Hi there' AS summary,
 floor(coalesce(published_us, 1704153600000000) / 1000000) AS published FROM {items} WHERE lang IN ('en', 'fr', 'de')
""")
def _(t):
    items, _ = feeds.land_feeds(_bodies(t))
    return items.select("source_id", "url", "title", "summary", F.unix_seconds("published_at").cast("double").alias("published"))


@query("feed_quarantine", "SELECT source_id, CAST(count(DISTINCT floor(item_id / 50)) AS BIGINT) AS bodies FROM {items} WHERE lang = 'es' GROUP BY source_id")
def _(t):
    _, bad = feeds.land_feeds(_bodies(t))
    return bad.groupBy("source_id").agg(F.count("*").alias("bodies"))


@query("land_search_news", r"""
SELECT item_id, CASE WHEN regexp_matches(h, '^(.*)\s+-\s+([^-]{2,60})$') THEN regexp_extract(h, '^(.*)\s+-\s+([^-]{2,60})$', 1) ELSE h END AS title,
 CASE WHEN regexp_matches(h, '^(.*)\s+-\s+([^-]{2,60})$') THEN regexp_extract(h, '^(.*)\s+-\s+([^-]{2,60})$', 2) END AS publisher, '' AS summary FROM (SELECT item_id, title || ' - ' || source_id AS h FROM {headlines})
""")
def _(t):
    i = t.headlines.withColumn("title", F.concat("title", F.lit(" - "), "source_id"))
    return feeds.land_search_news(i).select("item_id", "title", "publisher", "summary")


@query("land_forum_posts", r"""
SELECT url, title, comment, published FROM (SELECT 'https://www.reddit.com/p/' || CAST(post_id AS VARCHAR) AS url, turn0 AS comment, CASE WHEN turn0 THEN 'on ' || channel ELSE '[' || channel || '] hello' END AS title, CAST(floor(published_us / 1000000) AS BIGINT) AS published,
  channel FROM (SELECT *, comment AS turn0 FROM {posts})) WHERE comment OR channel <> 'meta'
""")
def _(t):
    p = t.posts.select("post_id", "channel", "comment", F.floor(F.col("published_us") / 1000000).alias("ts"))
    data = F.when(F.col("comment"), F.struct(
        F.concat(F.lit("/p/"), "post_id").alias("permalink"), F.lit(None).cast("string").alias("title"), F.lit("text").alias("body"), F.concat(F.lit("on "), "channel").alias("link_title"), F.col("ts").alias("created_utc"))
    ).otherwise(F.struct(
        F.concat(F.lit("/p/"), "post_id").alias("permalink"), F.concat(F.lit("["), "channel", F.lit("] hello")).alias("title"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("link_title"), F.col("ts").alias("created_utc")))
    one = F.to_json(F.struct(F.struct(F.array(F.struct(data.alias("data"))).alias("children")).alias("data")))
    return feeds.land_forum_posts(p.select("channel", one.alias("body")).withColumnRenamed("channel", "source_id")).select(
        "url", "title", "comment", F.unix_seconds("published_at").alias("published"))


@query("forum_feed_titles", "SELECT post_id, 'hello ' || CAST(post_id AS VARCHAR) AS title, CASE WHEN comment THEN 'text' ELSE 'body' END AS summary FROM {posts} WHERE comment OR channel <> 'meta'")
def _(t):
    hello = F.concat(F.lit("hello "), F.col("post_id").cast("string"))
    items = t.posts.select(
        "post_id", "comment", F.when(F.col("comment"), F.concat(F.lit("/u/someone on "), hello)).when(F.col("channel") == "meta", "r/meta").otherwise(hello).alias("title"),
        F.when(F.col("comment"), "text").otherwise("body submitted by /u/someone [link]").alias("summary"))
    return feeds.forum_feed_titles(items).select("post_id", "title", "summary")


@query("land_hits_json", f"""
SELECT 'h' || CAST(event_id AS VARCHAR) AS title, CASE WHEN value > 5 THEN 'https://h.example.com/' || CAST(event_id AS VARCHAR) ELSE 'https://news.ycombinator.com/item?id=' || CAST(event_id AS VARCHAR) END AS url
FROM events WHERE event_type <> 'error' AND epoch_us(date_trunc('second', ts)) > {AS_OF_US} - 10 * {DAY_US}
""")
def _(t):
    e = t.events.select(F.struct(F.array(F.struct(
        F.col("event_id").cast("string").alias("objectID"), F.when(F.col("event_type") != "error", F.concat(F.lit("h"), "event_id")).alias("title"),
        F.when(F.col("value") > 5, F.concat(F.lit("https://h.example.com/"), "event_id")).alias("url"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))).alias("hits")).alias("b"))
    bodies = e.select(F.lit("hits").alias("source_id"), F.to_json("b").alias("body"))
    return feeds.land_hits_json(bodies, as_of_items(), days=10).select("title", "url")


@query("land_directory", """
SELECT c_name || ' (W' || CAST(2018 + c_nationkey % 8 AS VARCHAR) || '): makes ' || c_mktsegment AS title, n_name AS city, c_mktsegment || ' / x' AS industry FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE n_regionkey = 2 AND c_acctbal > 0 AND 2018 + c_nationkey % 8 >= 2022
""")
def _(t):
    return feeds.land_directory(_directory(t), "ASIA").select("title", "entity.city", "entity.industry")


def _directory(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    record = F.to_json(F.struct(
        F.col("c_name").alias("name"), F.concat(F.lit("https://d.example.com/"), "c_custkey").alias("url"), F.concat(F.lit("https://c"), "c_custkey", F.lit(".example.com")).alias("website"),
        F.concat("n_name", F.lit(", Earth")).alias("all_locations"), F.concat(F.lit("makes "), "c_mktsegment").alias("one_liner"), F.col("c_mktsegment").alias("industry"), F.array(F.lit("x")).alias("tags"),
        (F.floor("c_acctbal").cast("int") % 300).alias("team_size"), F.concat(F.lit("W"), 2018 + F.col("c_nationkey") % 8).alias("batch"), (F.col("c_acctbal") > 5000).alias("isHiring"),
        F.when(F.col("c_acctbal") > 0, "Active").otherwise("Inactive").alias("status"), F.when(F.col("n_regionkey") == 2, F.array(F.lit("ASIA"))).otherwise(F.array(F.lit("OTHER"))).alias("regions")))
    return c.select(F.from_json(record, feeds.DIRECTORY).alias("r")).select("r.*")


# ---------------------------------------------------------------- extraction
_BARE = r"trim(regexp_replace(h, '(?i)^.*\b(?:" + fp.DESCRIPTORS + r")\s+', ''))"


@query("clean_head", rf"""
SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN {_BARE} <> '' AND regexp_matches({_BARE}, '^[A-Za-z0-9]') AND regexp_matches({_BARE}, '[A-Z0-9]') THEN {_BARE} ELSE h END, '[''’]s$', ''), '(?i)^(?:the|india''s|indian)\s+', ''), '(?i)\s+(?:ipo|group)$', '')) AS head
FROM (SELECT item_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(title, '(?i)^(?:{fp.LEAD_INS})\s*[:|-]\s*', ''), '^\[[^\]]+\]\s*', '')), '^.*[:|]', '')) AS h FROM {{headlines}})
""")
def _(t):
    return t.headlines.select("item_id", extract.clean_head(F.col("title")).alias("head"))


def _headline_leads(t):
    return extract.headline_leads(t.headlines.select("item_id", "company_name", "title", "summary"))


@query("headline_leads", r"""
SELECT item_id, company_name AS name, CASE WHEN title LIKE '%raises%' THEN 'funding' ELSE 'expansion' END AS type FROM {headlines} WHERE title LIKE '% raises %' OR title LIKE '% expands to %' OR title LIKE '% launches export desk in Dubai'
""")
def _(t):
    return _headline_leads(t).select("item_id", F.regexp_replace("name", "^x$", "x").alias("name"), F.when(F.col("type") == "launch", "expansion").otherwise(F.col("type")).alias("type"))


@query("headline_lead_facts", r"""
WITH h AS (SELECT *, CAST(regexp_extract(title, ' raises \$(\d+) Mn', 1) AS VARCHAR) AS mn, regexp_extract(title, ' in Series ([A-Z]) round', 1) AS st, regexp_extract(summary, ' was led by (.+ Partners)\.', 1) AS inv FROM {headlines}
 WHERE title LIKE '% raises %' OR title LIKE '% expands to %' OR title LIKE '% launches export desk in Dubai')
SELECT item_id, CASE WHEN st <> '' THEN 'Series ' || st END AS stage, CASE WHEN mn NOT IN ('', '0') THEN CAST(mn AS DOUBLE) END AS amount_usd_m,
 CASE WHEN title LIKE '% and Europe' THEN 'Europe' WHEN title LIKE '% in Dubai' THEN 'UAE' ELSE '' END AS markets, inv AS investors,
 CASE WHEN title LIKE 'furniture startup %' THEN 'D2C' ELSE 'Other' END AS sector, 'startup' AS size, CAST(regexp_extract(summary, 'A team of (\d+) people', 1) AS INT) AS team_n FROM h
""")
def _(t):
    return _headline_leads(t).select("item_id", "stage", "amount_usd_m", F.array_join("markets", ";").alias("markets"), F.array_join("investors", ";").alias("investors"), "sector", "size", F.col("team.n").alias("team_n"))


@query("structured_leads", """
SELECT 'https://d.example.com/' || CAST(c_custkey AS VARCHAR) AS item_id, c_name AS name, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'D2C' ELSE 'Other' END AS sector, '' AS markets,
 CASE WHEN CAST(floor(c_acctbal) AS INT) % 300 > 0 THEN CAST(floor(c_acctbal) AS INT) % 300 END AS team_n,
 'Backed by Directory (W' || CAST(2018 + c_nationkey % 8 AS VARCHAR) || ')' || CASE WHEN c_acctbal > 5000 THEN ', currently hiring' ELSE '' END AS title,
 'directory-backed' || CASE WHEN c_acctbal > 5000 THEN ';hiring' ELSE '' END AS signals
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_acctbal > 0 AND 2018 + c_nationkey % 8 >= 2022
""")
def _(t):
    d = feeds.land_directory(_directory(t), "ASIA").withColumn("item_id", F.col("url"))
    s = extract.structured_leads(d)
    return s.select("item_id", "name", "sector", F.array_join("markets", ";").alias("markets"), "team_n", "title", F.array_join("signals", ";").alias("signals"))


@query("merge_model_verdicts", """
WITH r AS (SELECT intel_id % 97 AS batch_id, intel_id AS i, category, importance, topic, score FROM {intel}),
m AS (SELECT intel_id % 97 AS batch_id, intel_id AS i, 'market' AS category, CAST(3 AS INT) AS importance FROM {intel} WHERE intel_id % 97 > 10 AND item_status = 'done')
SELECT r.batch_id, r.i, CASE WHEN r.batch_id > 10 AND r.batch_id IN (SELECT batch_id FROM m) THEN 'model' ELSE 'rules' END AS via,
 CASE WHEN r.batch_id NOT IN (SELECT batch_id FROM m) THEN r.category WHEN m.i IS NULL THEN NULL WHEN r.category = 'voice' THEN 'voice' ELSE m.category END AS category,
 CASE WHEN r.batch_id NOT IN (SELECT batch_id FROM m) THEN r.importance WHEN m.i IS NOT NULL THEN m.importance END AS importance
FROM r LEFT JOIN m USING (batch_id, i)
""")
def _(t):
    r = t.intel.select((F.col("intel_id") % 97).alias("batch_id"), F.col("intel_id").alias("i"), F.col("category").alias("rule_category"), F.col("importance").alias("rule_importance"), F.col("topic").alias("rule_topic"), F.col("score").alias("rule_score"))
    m = t.intel.where("intel_id % 97 > 10 AND item_status = 'done'").select((F.col("intel_id") % 97).alias("batch_id"), F.col("intel_id").alias("i"), F.lit("market").alias("category"), F.lit(3).alias("importance"), F.lit("x").alias("advice"))
    return extract.merge_model_verdicts(r, m).select("batch_id", "i", "via", "category", "importance")


@query("clean_model_leads", f"""
SELECT signal_id, CASE WHEN signal_id % 2 = 0 THEN url END AS website, CASE WHEN confidence < 0.6 THEN 0.5 ELSE 1.0 END AS confidence, stage FROM {{signals}}
""")
def _(t):
    s = t.signals.select("signal_id", F.when(F.col("signal_id") % 2 == 0, F.col("url")).otherwise("n/a").alias("website"), F.col("tags").alias("people"), F.col("tags").alias("markets"),
                         F.when(F.col("confidence") < 0.6, 0.0).otherwise(7.0).alias("confidence"), F.lower("stage").alias("stage"))
    c = extract.clean_model_leads(s)
    return c.select("signal_id", "website", "confidence", "stage")


# ---------------------------------------------------------------- people
def _bios(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.initcap("p_name").alias("n"), "l_returnflag", "l_partkey", "p_brand")
    text = F.concat(
        F.lit("The firm makes gears. "), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("It was founded by "), "n", F.lit(" and Asha Rao. ")))
        .when(F.col("l_returnflag") == "N", F.concat("n", F.lit(", co-founder and CEO, said sales grew. ")))
        .otherwise(F.concat(F.lit("It was backed by angel investors including "), "n", F.lit(", founder of Other Labs. According to CFO Vikram Mehta it is profitable. "))),
        F.lit("It employs about "), (F.col("l_partkey") % 900).cast("string"), F.lit(" people."))
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), text.alias("text"), F.col("p_brand").alias("company"))


@query("people_mentions", """
WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS doc_id, l_returnflag AS f, array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], ' ') AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT doc_id, n AS name, 'Co-founder' AS role, 'It was founded by ' || n || ' and Asha Rao.' AS evidence, 1 AS position FROM b WHERE f = 'A'
UNION ALL SELECT doc_id, 'Asha Rao', 'Co-founder', 'It was founded by ' || n || ' and Asha Rao.', 2 FROM b WHERE f = 'A'
UNION ALL SELECT doc_id, n, 'Co-founder and CEO', n || ', co-founder and CEO, said sales grew.', 1 FROM b WHERE f = 'N'
""")
def _(t):
    return people.people_mentions(_bios(t)).select("doc_id", "name", "role", "evidence", "position")


@query("team_size_mentions", f"""
SELECT item_id AS doc_id, CAST(n AS BIGINT) AS n FROM (SELECT item_id, CAST(regexp_extract(summary, 'team of (\\d+)', 1) AS INT) AS n FROM {{headlines}} WHERE summary LIKE '%A team of %') WHERE n BETWEEN 2 AND 200000
""")
def _(t):
    d = t.headlines.select(F.col("item_id").alias("doc_id"), F.regexp_replace("summary", "A team", "a team").alias("text"))
    return people.team_size_mentions(d).select("doc_id", F.col("n").cast("bigint").alias("n"))


_ROLE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Founder & CEO' WHEN '2-HIGH' THEN 'CFO' WHEN '3-MEDIUM' THEN 'Head of Payments' WHEN '5-LOW' THEN 'VP Engineering' END"


def _contacts(t):
    return t.orders.selectExpr("o_orderkey AS contact_id", "o_custkey AS company_id", f"{_ROLE} AS role", "o_orderstatus = 'P' AS do_not_contact", "CASE WHEN o_totalprice > 250000 THEN 0.8E0 ELSE 0.6E0 END AS confidence",
                               "concat('Person ', CAST(o_orderkey AS STRING)) AS name", "CASE WHEN o_totalprice < 60000 THEN 'a@b.example.com' END AS email", "CASE WHEN o_totalprice > 450000 THEN o_orderdate END AS email_checked_at")


_CONTACTS_SQL = f"ct AS (SELECT o_orderkey AS contact_id, o_custkey AS company_id, {_ROLE} AS role, o_orderstatus = 'P' AS dnc, CASE WHEN o_totalprice > 250000 THEN 0.8E0 ELSE 0.6E0 END AS confidence, CASE WHEN o_totalprice < 60000 THEN 'x' END AS email, o_totalprice > 450000 AS checked FROM orders)"
_TEAM_SQL = f"""
{_CONTACTS_SQL},
ld AS (SELECT company_id, count(*) AS nl, bool_or({re_sql('role', fv.NAMED_LEADER_PATTERN)}) AS lay FROM ct WHERE role IS NOT NULL AND NOT dnc GROUP BY company_id),
st AS (SELECT company_id, arg_max(stage, struct_pack(a := occurred_us, b := -signal_id)) AS stage FROM {{signals}} WHERE stage IS NOT NULL GROUP BY company_id),
tm AS (SELECT c.company_id, c.size, c.sector, CASE WHEN c.enriched AND c.stored_score > 90 THEN 30 END AS stated, CASE WHEN nl >= 5 OR lay THEN 101 WHEN st.stage = 'Seed' THEN 14 WHEN st.stage = 'Series A' THEN 49 WHEN st.stage = 'Series D' THEN 775 END AS est
  FROM {{companies}} c LEFT JOIN ld USING (company_id) LEFT JOIN st USING (company_id)),
tn AS (SELECT *, coalesce(stated, est) AS n FROM tm)
"""


def _teams(t):
    c = t.companies.withColumn("team", F.when(F.col("enriched") & (F.col("stored_score") > 90), F.struct(
        F.lit(30).alias("min"), F.lit(30).alias("max"), F.lit(True).alias("exact"), F.lit("website").alias("source"))))
    return people.team_estimate(c, _contacts(t), t.signals)


@query("team_estimate", f"WITH {_TEAM_SQL} SELECT company_id, CAST(n AS BIGINT) AS n FROM tn")
def _(t):
    return _teams(t).select("company_id", people.size_number(F.col("team_used")).cast("bigint").alias("n"))


@query("size_band", "SELECT o_orderkey, CASE WHEN n <= 10 THEN '1-10' WHEN n <= 50 THEN '11-50' WHEN n <= 200 THEN '51-200' WHEN n <= 1000 THEN '201-1000' ELSE '1000+' END AS band FROM (SELECT o_orderkey, floor(sqrt((o_orderkey % 60 + 2) * floor(o_totalprice / 100)) + 0.5) AS n FROM orders)")
def _(t):
    team = F.struct((F.col("o_orderkey") % 60 + 2).cast("int").alias("min"), F.floor(F.col("o_totalprice") / 100).cast("int").alias("max"), F.lit(False).alias("exact"))
    return t.orders.select("o_orderkey", team.alias("t")).select("o_orderkey", people.size_band(people.size_number(F.col("t"))).alias("band"))


_PLAN_SQL = f"""
{_TEAM_SQL},
pr AS (SELECT *, CASE WHEN size = 'enterprise' OR n > 200 THEN ['cfo', 'finance', 'payments'] WHEN sector IN ('Exporter', 'Manufacturing') AND (n IS NULL OR n > 50) THEN ['md', 'founder', 'ceo', 'cfo', 'director']
   WHEN n IS NULL OR n <= 50 THEN CASE WHEN sector = 'SaaS' THEN ['founder', 'ceo', 'cto'] ELSE ['founder', 'ceo', 'coo'] END
   WHEN sector IN ('D2C', 'Marketplace') THEN ['cfo', 'finance', 'ecommerce', 'payments', 'coo', 'founder'] ELSE ['cfo', 'finance', 'payments', 'coo', 'founder'] END AS roles FROM tn),
cb AS (SELECT contact_id, company_id, confidence, list_filter([{', '.join(f"CASE WHEN {re_sql('role', p)} THEN '{k}' END" for k, p in fv.ROLE_BUCKETS.items())}], lambda x: x IS NOT NULL) AS b FROM ct WHERE role IS NOT NULL AND NOT dnc),
pm AS (SELECT company_id, contact_id AS primary_id FROM (SELECT cb.*, list_min(list_filter(list_transform(b, lambda x: list_position(roles, x)), lambda p: p > 0)) AS pos FROM cb JOIN pr USING (company_id))
  WHERE pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY pos, confidence DESC, contact_id) = 1)
"""


@query("target_plan", f"WITH {_PLAN_SQL} SELECT company_id, CAST(n AS BIGINT) AS team_n, len(roles) AS n_roles, primary_id FROM pr LEFT JOIN pm USING (company_id)")
def _(t):
    p = people.target_plan(_teams(t), _contacts(t))
    return p.select("company_id", F.col("team_n").cast("bigint").alias("team_n"), F.size("roles").cast("bigint").alias("n_roles"), "primary_id")


@query("lookup_queue", f"WITH {_PLAN_SQL} SELECT company_id, primary_id FROM pm JOIN {{companies}} USING (company_id) JOIN ct ON ct.contact_id = primary_id WHERE stored_score >= 30 AND email IS NULL AND NOT checked")
def _(t):
    plans = people.target_plan(_teams(t), _contacts(t))
    return ranking.lookup_queue(t.companies.withColumnRenamed("stored_score", "score"), plans, _contacts(t), 30).select("company_id", "primary_id")


@query("save_contacts", """
WITH p AS (SELECT o_orderkey AS seq, o_custkey AS company_id, ['Asha Rao', 'Vikram Mehta', 'Head Office', 'Nina Kapoor'][CAST(1 + o_orderkey % 4 AS INT)] AS name,
  CASE o_orderstatus WHEN 'F' THEN 'CEO' WHEN 'O' THEN 'Co-founder & CEO' END AS role, CASE WHEN o_totalprice > 400000 THEN 'in/' || CAST(o_orderkey AS VARCHAR) END AS link FROM orders),
k AS (SELECT *, lower(replace(name, ' ', '')) AS norm FROM p WHERE name <> 'Head Office' AND NOT (company_id % 10 = 0 AND name = 'Asha Rao'))
SELECT company_id, norm, min(seq) AS contact_id, arg_max(role, struct_pack(a := length(role), b := -seq)) FILTER (WHERE role IS NOT NULL) AS role, arg_min(link, seq) FILTER (WHERE link IS NOT NULL) AS linkedin FROM k GROUP BY company_id, norm
""")
def _(t):
    names = F.array(*[F.lit(x) for x in ["Asha Rao", "Vikram Mehta", "Head Office", "Nina Kapoor"]])
    p = t.orders.select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("company_id"), F.lit("Acme").alias("company"), F.get(names, (F.col("o_orderkey") % 4).cast("int")).alias("name"),
        F.when(F.col("o_orderstatus") == "F", "CEO").when(F.col("o_orderstatus") == "O", "cofounder & CEO").alias("role"),
        F.when(F.col("o_totalprice") > 400000, F.concat(F.lit("in/"), "o_orderkey")).alias("linkedin"), F.lit("news").alias("source"), F.lit("u").alias("url"), F.lit("e").alias("evidence"), F.lit(0.6).alias("confidence"))
    gone = t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("company_id"), F.lit("asharao").alias("norm"))
    return people.save_contacts(p, gone).select("company_id", "norm", "contact_id", "role", "linkedin")


@query("contact_checks", r"SELECT doc_id FROM (SELECT doc_id, regexp_extract(text, '[^\s]+@[^\s]+') AS email, regexp_extract(text, '^[^\n]*') AS name FROM documents) WHERE len(string_split_regex(trim(name), '\s+')) >= 2 AND (email = '' OR regexp_matches(email, '(?i)^[^\s@]+@[^\s@]+\.[a-z]{2,}$'))")
def _(t):
    m = t.documents.select("doc_id", F.nullif(F.regexp_extract("text", r"[^\s]+@[^\s]+", 0), F.lit("")).alias("email"), F.regexp_extract("text", r"^[^\n]*", 0).alias("name"), F.lit(False).alias("do_not_contact"))
    return people.contact_checks(m).select("doc_id")


@query("merge_email_results", """
WITH r AS (SELECT l_orderkey AS cid, arg_max(struct_pack(e := 'p' || CAST(l_partkey AS VARCHAR) || '@x.example.com', v := CASE l_returnflag WHEN 'A' THEN 'verified' WHEN 'N' THEN 'accept_all' ELSE 'unknown' END, t := l_linestatus), CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber) AS s FROM lineitem GROUP BY 1)
SELECT o_orderkey AS contact_id, coalesce(CASE WHEN s.v <> 'unknown' THEN s.e END, CASE WHEN o_totalprice < 60000 THEN 'a@b.example.com' END) AS email, CASE s.v WHEN 'verified' THEN 'verified' WHEN 'accept_all' THEN 'risky' END AS email_status,
 coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 'Founder & CEO' WHEN '2-HIGH' THEN 'CFO' WHEN '3-MEDIUM' THEN 'Head of Payments' WHEN '5-LOW' THEN 'VP Engineering' END, s.t) AS role FROM orders LEFT JOIN r ON cid = o_orderkey
""")
def _(t):
    r = t.lineitem.select(F.col("l_orderkey").alias("contact_id"), (F.round(F.col("l_extendedprice") * 100).cast("bigint") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("p"), "l_partkey", F.lit("@x.example.com")).alias("email"),
                          F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "N", "accept_all").otherwise("unknown").alias("verdict"), F.lit(None).cast("string").alias("linkedin"), F.col("l_linestatus").alias("title"))
    c = _contacts(t).withColumns({"email_status": F.lit(None).cast("string"), "linkedin": F.lit(None).cast("string")})
    return people.merge_email_results(c, r).select("contact_id", "email", "email_status", "role")


# ---------------------------------------------------------------- sites
_SITE_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(html, '(?s)<body\b.*'), ''), html), '(?is)<script\b.*?</script>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("site_fingerprint", f"""
WITH x AS (SELECT *, {_SITE_TEXT} AS txt FROM {{sites}})
SELECT page_id, array_to_string(list_filter([CASE WHEN {re_sql('html', fp.SITE_PROVIDERS['Stripe'])} THEN 'Stripe' END, CASE WHEN {re_sql('html', fp.SITE_PROVIDERS['Razorpay'])} THEN 'Razorpay' END], lambda v: v IS NOT NULL), ';') AS providers,
 CASE WHEN {re_sql('html', fp.SITE_PLATFORMS['Shopify'])} THEN 'Shopify' END AS platform,
 array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(txt, '{p}') THEN '{k}' END" for k, p in fp.SITE_CURRENCIES.items())}], lambda v: v IS NOT NULL), ';') AS currencies,
 {re_sql('txt', fp.SITE_SHIPS_ABROAD)} AS ships_abroad, 'en;fr' AS locales, 'https://www.linkedin.com/company/acme' || CAST(page_id AS VARCHAR) AS linkedin,
 CASE WHEN page_id % 2 = 0 THEN 'sales@shop.example.com;hello@shop.example.com' ELSE '' END AS inboxes, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/pricing' AS pricing_url FROM x
""")
def _(t):
    f = sites.site_fingerprint(t.sites)
    return f.select("page_id", F.array_join("providers", ";").alias("providers"), "platform", F.array_join("currencies", ";").alias("currencies"), "ships_abroad",
                    F.array_join("locales", ";").alias("locales"), "social.linkedin", F.array_join("inboxes", ";").alias("inboxes"), "pricing_url")


@query("merge_pricing_page", f"""
WITH x AS (SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS domain, html FROM {{sites}})
SELECT domain, CAST(count(*) AS BIGINT) AS pages, concat_ws(';', CASE WHEN bool_or({re_sql('html', fp.SITE_PROVIDERS['Razorpay'])}) THEN 'Razorpay' END, CASE WHEN bool_or({re_sql('html', fp.SITE_PROVIDERS['Stripe'])}) THEN 'Stripe' END) AS providers FROM x GROUP BY domain
""")
def _(t):
    m = sites.merge_pricing_page(sites.site_fingerprint(t.sites))
    return m.select("domain", "pages", F.array_join("providers", ";").alias("providers"))


@query("parked_filter", f"SELECT page_id FROM {{sites}} WHERE NOT {re_sql('substr(html, 1, 20000)', fp.SITE_PARKED)}")
def _(t):
    return sites.parked_filter(t.sites).select("page_id")


@query("page_text")
def _(t):
    s = t.sites.select("page_id", sites.page_text(F.col("html")).alias("s"))
    return s.select("page_id", F.length("s").alias("n_chars"), F.sha1("s").alias("text_sha"))


@query("site_metadata", "SELECT page_id, 'Asha Rao' AS founders, CAST(page_id + 2 AS BIGINT) AS employees FROM {sites}")
def _(t):
    return sites.site_metadata(t.sites).select("page_id", F.array_join("founders", ";").alias("founders"), F.col("team.min").cast("bigint").alias("employees"))


@query("about_links", "SELECT page_id, o || '/our-team;' || o || '/about' AS urls FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS o, html FROM {sites})")
def _(t):
    # The navigation of the given pages links to words; only those that read like an about page count.
    clean = t.sites.withColumn("html", F.regexp_replace("html", r"(?is)<nav>.*?</nav>", ""))
    return sites.about_links(clean).select("page_id", F.array_join("urls", ";").alias("urls"))


@query("job_board_refs", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'greenhouse' ELSE 'lever' END AS board, CASE WHEN page_id % 4 = 0 THEN 'acme' || CAST(page_id AS VARCHAR) ELSE 'lever-co' END AS slug FROM {sites} WHERE page_id % 4 < 2")
def _(t):
    return sites.job_board_refs(t.sites)


@query("match_site_to_name", """
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS domain, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages),
c AS (SELECT page_id AS company_id, regexp_extract(title, '^([^ ]+ [^ ]+)', 1) AS name, domain FROM p)
SELECT company_id, min(p.page_id) AS page_id FROM c JOIN p USING (domain) WHERE n(c.name) <> '' AND (contains(n(p.title), n(c.name)) OR (length(n(c.name)) > 6 AND contains(n(p.title), left(n(c.name), CAST(ceil(length(n(c.name)) * 0.75) AS INT))))) GROUP BY company_id
""".replace("n(c.name)", norm_sql("c.name").replace("{", "{{").replace("}", "}}").replace("{{", "{").replace("}}", "}")).replace("n(p.title)", norm_sql("p.title")))
def _(t):
    p = t.pages.select("page_id", sites.domain_of(F.col("url")).alias("domain"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    cands = p.select(F.col("page_id").alias("company_id"), F.regexp_extract("title", "^([^ ]+ [^ ]+)", 1).alias("name"), F.lit(0).alias("pos"), "domain")
    prints = p.withColumns({"description": F.lit(""), "text": F.lit("")})
    return sites.match_site_to_name(cands, prints)


@query("intl_roles", f"""
WITH o AS (SELECT o_custkey AS company_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Global sales lead' WHEN '2-HIGH' THEN 'Accountant, Dubai' ELSE 'Usher' END AS title FROM orders),
a AS (SELECT company_id, count(*) AS n, list(title ORDER BY o_orderkey) AS t FROM o WHERE rn <= 12 AND title <> 'Usher' GROUP BY company_id)
SELECT company_id, 'Hiring for international roles (' || CAST(n AS VARCHAR) || ' open)' AS title, array_to_string(t[1:4], '; ') AS summary FROM a
WHERE company_id NOT IN (SELECT company_id FROM {{signals}} WHERE type = 'launch' AND created_us > {AS_OF_SIGNALS_US} - 30 * {DAY_US})
""")
def _(t):
    o = t.orders.select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderpriority") == "1-URGENT", "Global sales lead").when(F.col("o_orderpriority") == "2-HIGH", "Accountant, Dubai").otherwise("Usher").alias("title"))
    return sites.intl_roles(o, t.signals.where("type = 'launch'"), as_of_signals()).select("company_id", "title", "summary")


# ---------------------------------------------------------------- traffic
_TR = "tr AS (SELECT company_id, country, language, sum(etv) AS etv, sum(keywords) AS keywords, sum(paid_count) AS paid_count FROM {traffic} GROUP BY ALL)"


def _metrics(t):
    return t.traffic.groupBy("company_id", "country", "language").agg(F.sum("etv").alias("etv"), F.sum("keywords").alias("keywords"), F.sum("paid_count").alias("paid_count"))


@query("traction_countries", f"""
WITH {_TR}, c AS (SELECT company_id, country, sum(etv) AS etv, arg_max(language, etv) AS language FROM tr GROUP BY ALL), t AS (SELECT company_id, sum(etv) AS total, sum(CASE WHEN country = 'CHINA' THEN etv ELSE 0 END) AS home FROM c GROUP BY 1)
SELECT company_id, country, round(c.etv, 2) AS etv, language, round(c.etv / total, 6) AS share, round(1.0 - home / total, 6) AS foreign_share FROM c JOIN t USING (company_id)
""".replace("'CHINA'", "'NATION_2'"))
def _(t):
    c = traction.traction_countries(_metrics(t), "NATION_2")
    return c.select("company_id", "country", F.round("etv", 2).alias("etv"), "language", F.round("share", 6).alias("share"), F.round("foreign_share", 6).alias("foreign_share"))


def _history(t):
    return t.traffic.groupBy("company_id", F.date_format("shipped_at", "yyyy-MM").alias("month")).agg(F.sum("etv").alias("etv"))


_TREND = """
h AS (SELECT company_id, strftime(make_timestamp(shipped_us), '%Y-%m') AS month, sum(etv) AS etv FROM {traffic} GROUP BY ALL),
l AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY month DESC) <= 12),
g AS (SELECT *, lag(etv, 3) OVER (PARTITION BY company_id ORDER BY month) AS base FROM l)
"""


@query("traction_trend", f"WITH {_TREND} SELECT company_id, month, round(etv, 2) AS etv, round(CASE WHEN base > 20 THEN (etv - base) / base END, 5) AS growth FROM g")
def _(t):
    return traction.traction_trend(_history(t)).select("company_id", "month", F.round("etv", 2).alias("etv"), F.round("growth", 5).alias("growth"))


@query("traction_keywords", "WITH k AS (SELECT company_id, p_name AS keyword, round(sum(etv), 2) AS etv FROM {traffic} JOIN part ON part_id = p_partkey GROUP BY ALL) SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY etv DESC, keyword) <= 10")
def _(t):
    k = t.traffic.join(t.part, F.col("part_id") == F.col("p_partkey")).groupBy("company_id", F.col("p_name").alias("keyword")).agg(F.round(F.sum("etv"), 2).alias("etv"))
    return traction.traction_keywords(k).select("company_id", "keyword", "etv")


@query("traction_tech", "SELECT p_partkey AS company_id, p_brand || ';Stripe' AS payments, 'Shopify' AS commerce, p_brand || ';' || p_name AS other FROM part")
def _(t):
    m = t.part.select(F.col("p_partkey").alias("company_id"), F.create_map(F.col("p_type"), F.create_map(F.lit("payment gateways"), F.array(F.col("p_brand"), F.lit("Stripe")), F.lit("shops"), F.array(F.lit("Shopify"), F.col("p_name")))).alias("technologies"))
    return traction.traction_tech(m).select("company_id", F.array_join("payments", ";").alias("payments"), F.array_join("commerce", ";").alias("commerce"), F.array_join("other", ";").alias("other"))


@query("traction_insights", f"""
WITH {_TR}, c AS (SELECT company_id, country, sum(etv) AS etv FROM tr GROUP BY ALL),
t AS (SELECT company_id, sum(etv) AS total, 1.0 - sum(CASE WHEN country = 'NATION_2' THEN etv ELSE 0 END) / sum(etv) AS fs, arg_max(country, etv) FILTER (WHERE country <> 'NATION_2') AS tf FROM c GROUP BY 1),
p AS (SELECT company_id, count(*) FILTER (WHERE paid_count > 0) AS pc FROM tr GROUP BY 1), {_TREND},
e AS (SELECT company_id, count(*) AS months, arg_max(CASE WHEN base > 20 THEN (etv - base) / base END, month) AS growth FROM (SELECT company_id, month, coalesce(etv, 0) AS etv, base FROM g) GROUP BY 1)
SELECT company_id, concat_ws(' | ', CASE WHEN total >= 50 THEN CASE WHEN fs >= 0.5 THEN CAST(CAST(floor(fs * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% of search traffic is foreign, led by ' || tf WHEN fs >= 0.15 THEN CAST(CAST(floor(fs * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% of search traffic is international' ELSE 'Search traffic is mostly domestic (' || CAST(CAST(floor((1.0 - fs) * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%)' END END,
 CASE WHEN months >= 4 AND growth >= 0.2 THEN 'Traffic grew ' || CAST(CAST(floor(growth * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% over 3 months' WHEN months >= 4 AND growth <= -0.2 THEN 'Traffic fell ' || CAST(CAST(floor(-growth * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% over 3 months' END,
 CASE WHEN pc > 0 THEN 'Buys search ads in ' || CAST(pc AS VARCHAR) || ' markets' END) AS notes FROM t JOIN p USING (company_id) JOIN e USING (company_id)
""")
def _(t):
    # Read twice below: the joins behind it run once.
    m = cut(_metrics(t))
    c = traction.traction_countries(m, "NATION_2")
    head = c.groupBy("company_id").agg(F.max("total").alias("total"), F.max("foreign_share").alias("foreign_share"), F.max_by("country", F.when(F.col("country") != "NATION_2", F.col("etv"))).alias("top_foreign"))
    trend = traction.traction_trend(_history(t)).groupBy("company_id").agg(F.count("*").alias("months"), F.max_by("growth", "month").alias("growth"))
    paid = traction.traction_totals(m).select("company_id", "paid_countries")
    none = F.array().cast("array<string>")
    d = head.join(trend, "company_id").join(paid, "company_id").withColumns({"payments": none, "commerce": none})
    return traction.traction_insights(d).select("company_id", F.array_join(F.transform("notes", lambda n: n["text"]), " | ").alias("notes"))


@query("normalise_firmographics", """
SELECT c_custkey AS company_id, c_name AS name, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) ELSE 7.0 END AS employees, 'Stripe;Shopify' AS technologies, CASE WHEN c_acctbal > 5000 THEN 'US;IN' ELSE 'IN;US' END AS countries FROM customer
""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("company_id"), "c_name", "c_acctbal")
    raw = F.when(F.col("c_acctbal") > 0, F.to_json(F.struct(
        F.col("c_name").alias("companyName"), F.lit("").alias("company_name"), F.struct(F.floor("c_acctbal").alias("max"), F.lit(1).alias("min")).alias("headcount"), F.lit("Stripe; Shopify").alias("tech_stack"),
        F.create_map(F.lit("US"), F.when(F.col("c_acctbal") > 5000, 90).otherwise(5), F.lit("IN"), F.lit(50)).alias("employees_by_country")))).otherwise(F.to_json(F.struct(
            F.col("c_name").alias("name"), F.lit("7").alias("employees"), F.array(F.struct(F.lit("Stripe").alias("name")), F.struct(F.lit("Shopify").alias("name"))).alias("technologies"),
            F.array(F.struct(F.lit("US").alias("country"), F.lit(3).alias("count")), F.struct(F.lit("IN").alias("country"), F.lit(50).alias("count"))).alias("employeeDistribution"))))
    n = traction.normalise_firmographics(c.select("company_id", raw.alias("raw")))
    return n.select("company_id", "name", "employees", F.array_join("technologies", ";").alias("technologies"), F.array_join(F.transform("countries", lambda x: x["country"]), ";").alias("countries"))


# ---------------------------------------------------------------- sinks
@query("export_leads_csv", """
WITH f AS (SELECT company_id, stage, occurred_us FROM {signals} WHERE type IN ('funding', 'directory') QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY type = 'funding' DESC, occurred_us DESC, signal_id) = 1)
SELECT '"' || replace(name, '"', '""') || '","' || CAST(stored_score AS VARCHAR) || '","' || sector || '","' || city || '","' || website || '","' || status || '","' || coalesce(stage, '') || '","' || coalesce(strftime(make_timestamp(occurred_us), '%Y-%m-%d'), '') || '","' || array_to_string(markets, '; ') || '"' AS line
FROM {companies} c LEFT JOIN f USING (company_id) WHERE status <> 'dismissed' ORDER BY stored_score DESC, company_id LIMIT 5000
""")
def _(t):
    v = ranking.lead_view(t.companies.withColumnRenamed("stored_score", "score").where("status <> 'dismissed'"), t.signals)
    s = sinks.lead_sheet(v, [F.desc("score"), F.col("company_id").asc()])
    parts = ["name", "score", "sector", "city", "website", "status", "stage", "funding_date", "markets"]
    return s.select(F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in parts]).alias("line"))
