"""Lists, briefs, queues and reports."""

from pyspark.sql import functions as F

from ..functions import fixed_packs as fp
from ..functions import fixed_values as fv
from ..operators import ranking, reports, voice
from .bindings import AS_OF_SIGNALS_US, AS_OF_US, DAY_US, as_of_items, as_of_signals
from .gate_plans import SCORED_SQL
from .registry import query
from .score_plans import SCORED, scored_companies

_CHECK_US = AS_OF_SIGNALS_US - 60 * DAY_US
_OLD = f"{AS_OF_SIGNALS_US}"


def checkpoint():
    return F.timestamp_micros(F.lit(_CHECK_US))


def brief_input(t):
    last = t.signals.groupBy("company_id").agg(F.max("created_at").alias("last_event_at"))
    return scored_companies(t).drop("last_event_at").join(last, "company_id")


_LAST = "last AS (SELECT company_id AS lid, max(created_us) AS last_us FROM {signals} GROUP BY company_id)"
_CANDS = f"cands AS (SELECT company_id, sector, score, first_seen_us, last_us, row_number() OVER (ORDER BY score DESC, company_id) AS rank FROM scored JOIN last ON lid = company_id WHERE status <> 'dismissed' AND last_us > {_CHECK_US} AND score >= 20 QUALIFY rank <= 400)"


@query("brief_topk", f"""
WITH {SCORED}, {_LAST}, {_CANDS},
m AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY rank) = 1 AS fs FROM cands)
SELECT company_id, sector, score, rank > 20 AS explore, row_number() OVER (ORDER BY CASE WHEN rank <= 20 THEN 0 WHEN fs THEN 1 ELSE 2 END, rank) AS position FROM m QUALIFY position <= 25
""")
def _(t):
    b = ranking.brief_topk(brief_input(t), checkpoint())
    return b.select("company_id", "sector", F.col("score").cast("bigint").alias("score"), "explore", F.col("position").cast("bigint").alias("position"))


@query("brief_badges", f"""
WITH {SCORED}, {_LAST}, {_CANDS}
SELECT CAST(count(*) FILTER (WHERE first_seen_us > {_CHECK_US}) AS BIGINT) AS total_new, CAST(count(*) FILTER (WHERE first_seen_us <= {_CHECK_US}) AS BIGINT) AS total_updated FROM cands
""")
def _(t):
    return ranking.brief_badges(ranking.brief_candidates(brief_input(t), checkpoint()), checkpoint())


@query("brief_intel", f"""
SELECT intel_id, importance FROM {{intel}} WHERE created_us > {AS_OF_US - DAY_US} AND category <> 'voice' ORDER BY importance DESC, published_us DESC NULLS LAST, intel_id LIMIT 8
""")
def _(t):
    return ranking.brief_intel(t.intel, F.timestamp_micros(F.lit(AS_OF_US - DAY_US))).select("intel_id", "importance")


@query("hot_posts", f"SELECT CAST(count(*) AS BIGINT) AS hot FROM {{intel}} WHERE category = 'voice' AND status = 'new' AND score >= 80 AND created_us > {AS_OF_US - DAY_US}")
def _(t):
    return ranking.hot_posts(t.intel, F.timestamp_micros(F.lit(AS_OF_US - DAY_US)))


@query("newest_first_batch", "SELECT intel_id AS item_id FROM {intel} WHERE item_status = 'new' ORDER BY coalesce(published_us, created_us) DESC, intel_id DESC LIMIT 60")
def _(t):
    i = t.intel.select(F.col("intel_id").alias("item_id"), F.col("item_status").alias("status"), "published_at", F.col("created_at").alias("fetched_at"))
    return ranking.newest_first_batch(i).select("item_id")


@query("table_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 450000")
def _(t):
    return t.orders.where("o_orderstatus = 'P' AND o_totalprice > 450000").select("o_orderkey", "o_totalprice")


def stored(t):
    return t.companies.withColumnRenamed("stored_score", "score")


_SEARCH = f"""
SELECT company_id, name FROM {{companies}} c WHERE status <> 'dismissed' AND (name ILIKE '%7%' OR description ILIKE '%7%' OR why ILIKE '%7%' OR city ILIKE '%7%') AND sector = 'SaaS' AND stored_score >= 20
 AND EXISTS (SELECT 1 FROM {{signals}} s WHERE s.company_id = c.company_id AND s.stage = 'Seed') AND EXISTS (SELECT 1 FROM {{signals}} s WHERE s.company_id = c.company_id AND s.type = 'funding')
 AND (sells_intl IN ('yes', 'likely') OR len(markets) > 0) AND ({_OLD} - last_event_us) / 86400000000.0 < 50 AND size <> 'enterprise'
"""


@query("lead_search", _SEARCH)
def _(t):
    s = ranking.lead_search(stored(t), t.signals, as_of_signals(), q="7", sector="SaaS", min_score=20, stage="Seed", type="funding", intl=True, days=50, hide_enterprise=True)
    return s.select("company_id", "name")


@query("lead_search_page", "SELECT company_id, stored_score AS score FROM {companies} WHERE status <> 'dismissed' ORDER BY stored_score DESC, last_event_us DESC, company_id LIMIT 50 OFFSET 25")
def _(t):
    return ranking.page(ranking.lead_search(stored(t), t.signals, as_of_signals()), "score", 50, 25).select("company_id", "score")


@query("exists_filters", "SELECT company_id FROM {companies} c WHERE EXISTS (SELECT 1 FROM {signals} s WHERE s.company_id = c.company_id AND s.source_id = 'src3')")
def _(t):
    return ranking.having_signal(t.companies, t.signals, "source_id", "src3").select("company_id")


@query("latest_event", "SELECT company_id, signal_id, type FROM {signals} QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY occurred_us DESC, signal_id) = 1")
def _(t):
    return ranking.latest_event(t.signals).select("company_id", "latest.signal_id", "latest.type")


@query("latest_funding", "SELECT company_id, signal_id, type, stage FROM {signals} WHERE type IN ('funding', 'directory') QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY type = 'funding' DESC, occurred_us DESC, signal_id) = 1")
def _(t):
    return ranking.latest_funding(t.signals).select("company_id", "funding.signal_id", "funding.type", "funding.stage")


_TOPSIG = """
tg AS (SELECT company_id, tag, min(struct_pack(a := -occurred_us, b := signal_id, c := p)) AS ord FROM (SELECT company_id, occurred_us, signal_id, unnest(tags) AS tag, unnest([0, 1]) AS p FROM {signals}) GROUP BY company_id, tag),
tk AS (SELECT * FROM tg QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY ord, tag) <= 6),
ts AS (SELECT company_id, string_agg(tag, ';' ORDER BY ord) AS signals FROM tk GROUP BY company_id)
"""


@query("top_signals", f"WITH {_TOPSIG} SELECT * FROM ts")
def _(t):
    return ranking.top_signals(t.signals).select("company_id", F.array_join("signals", ";").alias("signals"))


@query("lead_view", f"""
WITH {_TOPSIG},
lf AS (SELECT company_id, stage FROM {{signals}} WHERE type IN ('funding', 'directory') QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY type = 'funding' DESC, occurred_us DESC, signal_id) = 1),
le AS (SELECT company_id, title FROM {{signals}} QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY occurred_us DESC, signal_id) = 1),
so AS (SELECT company_id, string_agg(DISTINCT source_id, ';' ORDER BY source_id) AS sources, count(*) AS n, sum(corroborations) AS c FROM {{signals}} GROUP BY company_id)
SELECT company_id, lf.stage AS funding_stage, le.title AS latest_title, ts.signals, so.sources, CAST(coalesce(so.n, 0) AS BIGINT) AS event_count, CAST(coalesce(so.c, 0) AS BIGINT) AS corroborations
FROM {{companies}} LEFT JOIN lf USING (company_id) LEFT JOIN le USING (company_id) LEFT JOIN ts USING (company_id) LEFT JOIN so USING (company_id)
""")
def _(t):
    v = ranking.lead_view(t.companies, t.signals)
    return v.select("company_id", F.col("funding.stage").alias("funding_stage"), F.col("latest.title").alias("latest_title"), F.array_join("signals", ";").alias("signals"),
                    F.array_join("sources", ";").alias("sources"), F.col("event_count").cast("bigint").alias("event_count"), F.col("corroborations").cast("bigint").alias("corroborations"))


@query("events_with_source", "SELECT signal_id, coalesce(name, s.source_id) AS source_name FROM {signals} s LEFT JOIN {sources} USING (source_id)")
def _(t):
    return ranking.events_with_source(t.signals, t.sources).select("signal_id", "source_name")


@query("recent_n_per_key", "SELECT company_id, type, signal_id FROM {signals} QUALIFY row_number() OVER (PARTITION BY company_id, type ORDER BY signal_id DESC) <= 2")
def _(t):
    return ranking.per_key(t.signals, ["company_id", "type"], [F.desc("signal_id")], 2).select("company_id", "type", "signal_id")


@query("enrich_queue", "SELECT company_id FROM {companies} WHERE (NOT enriched OR people_checked_us IS NULL) AND status <> 'dismissed' AND stored_score >= 40 AND size <> 'enterprise' ORDER BY stored_score DESC, company_id LIMIT 4")
def _(t):
    return ranking.enrich_queue(stored(t)).select("company_id")


@query("feedback_examples", "SELECT company_id, feedback FROM {companies} WHERE feedback <> 0 QUALIFY row_number() OVER (PARTITION BY feedback ORDER BY last_event_us DESC, company_id) <= 5")
def _(t):
    return ranking.feedback_examples(t.companies.withColumnRenamed("last_event_at", "updated_at")).select("company_id", "feedback")


@query("stale_payloads", f"SELECT company_id, ({_OLD} - last_event_us) / 86400000000.0 > CASE WHEN enriched THEN 7 ELSE 30 END AS stale FROM {{companies}}")
def _(t):
    p = t.companies.select("company_id", F.col("enriched").alias("found"), F.col("last_event_at").alias("fetched_at"))
    return ranking.stale_payloads(p, as_of_signals(), 7, 30).select("company_id", "stale")


@query("due_sources", f"SELECT source_id, row_number() OVER (ORDER BY next_run_us NULLS FIRST, source_id) AS position FROM {{sources}} WHERE enabled AND (next_run_us IS NULL OR next_run_us <= {AS_OF_US})")
def _(t):
    from pyspark.sql.window import Window

    d = ranking.due_sources(t.sources, as_of_items())
    w = Window.orderBy(F.asc_nulls_first("next_run_at"), "source_id")
    return d.select("source_id", F.row_number().over(w).cast("bigint").alias("position"))


@query("source_listing", "SELECT source_id FROM {sources}")
def _(t):
    return ranking.source_listing(t.sources).select("source_id")


@query("run_log", "SELECT run_id, name FROM (SELECT * FROM {runs} ORDER BY run_id DESC LIMIT 100) LEFT JOIN {sources} USING (source_id)")
def _(t):
    return ranking.run_log(t.runs, t.sources).select("run_id", "name")


@query("tune_cadence", """
WITH l AS (SELECT source_id, avg(new_items) AS m FROM (SELECT * FROM {runs} WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY run_id DESC) <= 4) GROUP BY source_id HAVING count(*) >= 3)
SELECT source_id, CAST(CASE WHEN m = 0 THEN least(max_cadence, floor(cadence_min * 1.5 + 0.5)) WHEN m >= 8 THEN greatest(min_cadence, floor(cadence_min * 0.75 + 0.5)) ELSE cadence_min END AS BIGINT) AS cadence_new
FROM {sources} JOIN l USING (source_id) WHERE enabled
""")
def _(t):
    return ranking.tune_cadence(t.sources, t.runs).select("source_id", F.col("cadence_new").cast("bigint").alias("cadence_new"))


@query("retire_queries", f"SELECT source_id, CASE WHEN leads_total > 0 AND NOT extended THEN 'extend' ELSE 'disable' END AS action FROM {{sources}} WHERE created_by = 'agent' AND enabled AND expires_us < {AS_OF_US}")
def _(t):
    return ranking.retire_queries(t.sources, as_of_items()).select("source_id", "action")


_INTENTS = ["raises Series A", "expands to US", "enters Europe"]


@query("segment_grid", "SELECT DISTINCT 'India ' || p_type || ' ' || p_name || ' ' || i AS query FROM part, (SELECT unnest(['raises Series A', 'expands to US', 'enters Europe']) AS i)")
def _(t):
    seg = t.part.select(F.concat_ws(" ", "p_type", "p_name").alias("segment")).distinct()
    return ranking.grid_of(seg, _INTENTS).select("query")


@query("rotate_queries", """
WITH g AS (SELECT DISTINCT 'India ' || p_type || ' ' || p_name || ' ' || i AS query FROM part, (SELECT unnest(['raises Series A', 'expands to US', 'enters Europe']) AS i)),
u AS (SELECT DISTINCT 'India ' || p_type || ' ' || p_name || ' ' || i AS query FROM part, (SELECT unnest(['raises Series A', 'expands to US']) AS i) WHERE p_size > 25)
SELECT g.query FROM g LEFT JOIN u ON u.query = g.query ORDER BY u.query IS NOT NULL, md5('0|' || g.query), g.query LIMIT 5
""")
def _(t):
    seg = t.part.select(F.concat_ws(" ", "p_type", "p_name").alias("segment")).distinct()
    grid = ranking.grid_of(seg, _INTENTS)
    used = ranking.grid_of(t.part.where("p_size > 25").select(F.concat_ws(" ", "p_type", "p_name").alias("segment")).distinct(), _INTENTS[:2])
    return ranking.rotate_queries(grid, used, 5).select("query")


@query("coverage_gap", "SELECT sector, CAST(count(*) AS BIGINT) AS n FROM {companies} GROUP BY sector")
def _(t):
    return ranking.coverage_gap(t.companies)


@query("lookalike_queries", """
SELECT company_id, unnest(['Indian ' || seg || ' ' || CASE WHEN len(m) > 0 THEN 'expands ' || array_to_string(m[1:2], ' OR ') ELSE 'international expansion' END || ' when:30d', 'Indian ' || seg || ' raises funding global customers when:30d']) AS query
FROM (SELECT company_id, list_filter(markets, lambda x: x <> 'Global') AS m, CASE sector WHEN 'SaaS' THEN 'SaaS startup' WHEN 'D2C' THEN 'D2C brand' WHEN 'Exporter' THEN 'exporter' WHEN 'Marketplace' THEN 'marketplace' ELSE 'startup' END AS seg FROM {companies})
""")
def _(t):
    return ranking.lookalike_queries(t.companies)


@query("unseen_anti", "SELECT item_id FROM {items} i WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE i.item_id = p.page_id) AND title NOT IN (SELECT title FROM {intel} WHERE category = 'voice')")
def _(t):
    from ..operators.dedup import unseen

    a = unseen(t.items, t.pages.select(F.col("page_id").alias("item_id")), ["item_id"])
    return unseen(a, t.intel.where("category = 'voice'"), ["title"]).select("item_id")


@query("unmatched_backfill", "SELECT DISTINCT s.company_id FROM {signals} s JOIN {companies} c USING (company_id) JOIN {headlines} h ON h.item_id = s.signal_id AND s.type = 'directory' WHERE people_checked_us IS NULL")
def _(t):
    missing = t.companies.where("people_checked_us IS NULL").select("company_id")
    found = t.headlines.select(F.col("item_id").alias("signal_id")).join(t.signals.where("type = 'directory'"), "signal_id")
    return found.join(missing, "company_id").select("company_id").distinct()


# ---------------------------------------------------------------- reports
_DAY = f"({AS_OF_US} - {{0}}) / 86400000000.0"


@query("kpi_counts", f"""
WITH co AS (SELECT count(*) FILTER (WHERE status <> 'dismissed') AS companies, count(*) FILTER (WHERE status <> 'dismissed' AND stored_score >= 55) AS high_intent,
  count(*) FILTER (WHERE ({AS_OF_US} - first_seen_us) / 86400000000.0 < 1) AS new_today, count(*) FILTER (WHERE status <> 'dismissed' AND sells_intl IN ('yes', 'likely')) AS intl_signals FROM {{companies}}),
sg AS (SELECT count(*) FILTER (WHERE ({AS_OF_US} - created_us) / 86400000000.0 < 1) AS events_24h, count(DISTINCT CASE WHEN type = 'funding' AND ({AS_OF_US} - occurred_us) / 86400000000.0 < 30 THEN company_id END) AS funding_signals FROM {{signals}}),
it AS (SELECT count(*) FILTER (WHERE ({AS_OF_US} - created_us) / 86400000000.0 < 1) AS intel_24h, count(*) FILTER (WHERE ({AS_OF_US} - created_us) / 86400000000.0 < 1) AS items_24h, count(*) AS items_total,
  count(*) FILTER (WHERE item_status IN ('done', 'processing')) AS passed_total, count(*) FILTER (WHERE item_status IN ('filtered', 'dup')) AS filtered_total, count(*) FILTER (WHERE item_status IN ('new', 'processing')) AS queue FROM {{intel}}),
so AS (SELECT count(*) FILTER (WHERE enabled) AS sources_active, count(*) FILTER (WHERE enabled AND last_status = 'error') AS sources_error, count(*) FILTER (WHERE enabled AND created_by = 'agent') AS agent_queries FROM {{sources}})
SELECT * FROM co, sg, it, so
""")
def _(t):
    return _kpis(t)


def _kpis(t):
    items = t.intel.select(F.col("item_status").alias("status"), F.col("created_at").alias("fetched_at"))
    return reports.kpi_counts(stored(t), t.signals, items, t.intel, t.sources, as_of_items())


@query("funnel", """
SELECT CAST(position AS INT) AS position, stage, CAST(n AS BIGINT) AS n FROM (
SELECT 0 AS position, 'read' AS stage, count(*) AS n FROM {intel} UNION ALL SELECT 1, 'passed', count(*) FROM {intel} WHERE item_status IN ('done', 'processing')
UNION ALL SELECT 2, 'companies', count(*) FROM {companies} WHERE status <> 'dismissed' UNION ALL SELECT 3, 'high intent', count(*) FROM {companies} WHERE status <> 'dismissed' AND stored_score >= 55
UNION ALL SELECT 4, 'sources live', count(*) FROM {sources} WHERE enabled)
""")
def _(t):
    return reports.funnel(_kpis(t))


@query("sector_stats", "SELECT sector, CAST(count(*) AS BIGINT) AS n, CAST(floor(avg(stored_score) + 0.5) AS BIGINT) AS avg_score FROM {companies} WHERE status <> 'dismissed' GROUP BY sector")
def _(t):
    return reports.sector_stats(stored(t))


@query("facet_counts", """
SELECT facet, value, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT 'category' AS facet, category AS value FROM {intel} UNION ALL SELECT 'status', status FROM {intel} UNION ALL SELECT 'segment', segment FROM {intel} UNION ALL SELECT 'intent', unnest(intents) FROM {intel}) WHERE value IS NOT NULL GROUP BY ALL
""")
def _(t):
    return reports.facet_counts(t.intel, {"category": reports.as_facet(F.col("category")), "status": reports.as_facet(F.col("status")),
                                          "segment": reports.as_facet(F.col("segment")), "intent": F.col("intents")})


_X = ("status = 'new'", "CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'research' ELSE 'monitor' END", "list_contains(intents, 'fees')", "contains(lower(title), 'the')")


@query("cross_filter_facets", f"""
SELECT facet, value, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT 'status' AS facet, status AS value FROM {{intel}} WHERE {_X[1]} = 'research' AND {_X[2]} AND {_X[3]}
 UNION ALL SELECT 'band', {_X[1]} FROM {{intel}} WHERE {_X[0]} AND {_X[2]} AND {_X[3]}
 UNION ALL SELECT 'intent', unnest(intents) FROM {{intel}} WHERE {_X[0]} AND {_X[1]} = 'research' AND {_X[3]}) GROUP BY ALL
""")
def _(t):
    band = voice.band_of(F.col("score"))
    return reports.cross_filter_facets(
        t.intel, {"status": F.col("status") == "new", "band": band == "research", "intent": F.array_contains("intents", "fees")},
        {"status": F.array("status"), "band": F.array(band), "intent": F.col("intents")}, F.lower("title").contains("the"))


def _posts(t):
    return voice.classify_voice(t.threads, as_of_signals()).withColumn("created_at", F.col("published_at"))


@query("voice_report", f"""
WITH {SCORED_SQL}, w AS (SELECT * FROM scored WHERE ({_OLD} - published_us) / 86400000000.0 < 7),
x AS (SELECT 'total' AS facet, 'posts' AS value FROM w UNION ALL SELECT 'band', band FROM w UNION ALL SELECT 'intent', unnest(CASE WHEN unhappy THEN list_append(ri, 'provider-complaint') ELSE ri END) FROM w
 UNION ALL SELECT 'segment', segment FROM w UNION ALL SELECT 'fit', fit FROM w WHERE fit IS NOT NULL UNION ALL SELECT 'provider', unnest(providers) FROM w
 UNION ALL SELECT 'complaint', unnest(providers) FROM w WHERE unhappy UNION ALL SELECT 'restricted', 'posts' FROM w WHERE restricted IS NOT NULL)
SELECT facet, value, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY ALL
""")
def _(t):
    return reports.voice_report(_posts(t), as_of_signals())


@query("channel_yield", f"""
WITH {SCORED_SQL}, w AS (SELECT unnest(string_split(channel || '+all', '+')) AS channel, score, status FROM scored WHERE ({_OLD} - published_us) / 86400000000.0 < 7)
SELECT channel, CAST(count(*) AS BIGINT) AS posts, CAST(count(*) FILTER (WHERE score >= 80) AS BIGINT) AS high, CAST(count(*) FILTER (WHERE status = 'replied') AS BIGINT) AS replied, CAST(count(*) FILTER (WHERE status = 'lead') AS BIGINT) AS lead
FROM w GROUP BY channel ORDER BY lead DESC, high DESC, posts DESC, channel LIMIT 12
""")
def _(t):
    p = _posts(t).withColumn("channel", F.concat("channel", F.lit("+all")))
    return reports.channel_yield(p, as_of_signals())


@query("topic_counts", f"SELECT topic, CAST(count(*) AS BIGINT) AS n FROM {{intel}} WHERE ({AS_OF_US} - coalesce(published_us, created_us)) / 86400000000.0 <= 20 AND importance >= 2 AND contains(lower(title || ' ' || advice), 'the') AND topic IS NOT NULL GROUP BY topic")
def _(t):
    return reports.topic_counts(t.intel, as_of_items(), days=20, q="the", min_importance=2)


@query("day_buckets", f"""
SELECT bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN 'Earlier this week' WHEN d < 30 THEN 'Earlier this month' ELSE 'Older' END AS bucket
 FROM (SELECT date_diff('day', CAST(make_timestamp(created_us - intel_id * 7 * 600000000) AS DATE), CAST(make_timestamp({AS_OF_US}) AS DATE)) AS d FROM {{intel}})) GROUP BY bucket
""")
def _(t):
    ts = F.timestamp_micros(F.col("created_us") - F.col("intel_id") * F.lit(7 * 600000000))
    return t.intel.select(reports.day_bucket(ts, as_of_items()).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("voice_inbox", f"""
WITH {SCORED_SQL}, n AS (SELECT * FROM scored WHERE status = 'new' AND list_contains(ri, 'fees') ORDER BY published_us DESC, post_id LIMIT 300)
SELECT post_id, band, row_number() OVER (ORDER BY CASE band WHEN 'high' THEN 0 WHEN 'research' THEN 1 ELSE 2 END, published_us DESC, post_id) AS position FROM n
""")
def _(t):
    from pyspark.sql.window import Window

    rows = reports.voice_inbox(_posts(t), intent="fees")
    w = Window.orderBy(F.when(F.col("band") == "high", 0).when(F.col("band") == "research", 1).otherwise(2), F.desc("published_at"), "post_id")
    return rows.select("post_id", "band", F.row_number().over(w).cast("bigint").alias("position"))


@query("intel_feed", "SELECT intel_id, name AS source_name FROM (SELECT * FROM {intel} WHERE category = 'market' ORDER BY coalesce(published_us, created_us) DESC, intel_id LIMIT 150) LEFT JOIN {sources} USING (source_id)")
def _(t):
    return reports.intel_feed(t.intel, t.sources, "market").select("intel_id", "source_name")


@query("source_yield", """
WITH a AS (SELECT source_id, count(*) AS items, count(*) FILTER (WHERE item_status IN ('done', 'processing')) AS passed FROM {intel} GROUP BY source_id),
b AS (SELECT source_id, count(*) AS leads FROM (SELECT company_id, arg_min(source_id, signal_id) AS source_id FROM {signals} GROUP BY company_id) GROUP BY source_id)
SELECT a.source_id, CAST(items AS BIGINT) AS items, CAST(passed AS BIGINT) AS passed, CAST(coalesce(leads, 0) AS BIGINT) AS leads FROM a LEFT JOIN b USING (source_id)
""")
def _(t):
    first = t.signals.groupBy("company_id").agg(F.min_by("source_id", "signal_id").alias("source_id"))
    return reports.source_yield(t.intel.select("source_id", F.col("item_status").alias("status")), first)


@query("extraction_mix", "SELECT via, CAST(count(*) AS BIGINT) AS n FROM {intel} GROUP BY via")
def _(t):
    return reports.extraction_mix(t.intel)


@query("usage_ledger", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, CAST(count(*) AS BIGINT) AS calls, round(sum(value), 2) AS cost, count(*) >= CASE event_type WHEN 'click' THEN 70 WHEN 'view' THEN 60 ELSE 1000000 END AS over_cap FROM events GROUP BY 1, 2")
def _(t):
    calls = t.events.select(F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.col("value").alias("cost"))
    u = reports.usage_ledger(calls, {"click": 70, "view": 60})
    return u.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "kind", "calls", F.round("cost", 2).alias("cost"), "over_cap")


@query("usage_by_month", "SELECT strftime(ts, '%Y-%m') AS month, event_type AS kind, CAST(count(*) AS BIGINT) AS calls, round(sum(value), 1) AS cost, count(*) >= CASE event_type WHEN 'click' THEN 400 ELSE 1000000 END AS over_cap FROM events GROUP BY 1, 2")
def _(t):
    calls = t.events.select(F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.col("value").alias("cost"))
    return reports.usage_by_month(calls, {"click": 400}).withColumn("cost", F.round("cost", 1))


_LEGACY_W = {"funding": 40, "international": 30, "sector": 15, "paymentPage": 10, "competitor": -15}
_LEGACY = """
lg AS (SELECT signal_id, CASE WHEN amount_usd_m IS NOT NULL THEN 40 ELSE 0 END + CASE WHEN corroborations > 1 THEN 30 ELSE 0 END + CASE WHEN type IN ('funding', 'launch') THEN 15 ELSE 0 END
 + CASE WHEN corroborations > 1 AND regexp_matches(tags[1], '(?i)payment|multi-currency|checkout|status f') THEN 10 ELSE 0 END + CASE WHEN len(competitors) > 0 THEN -15 ELSE 0 END AS s, amount_usd_m, corroborations FROM {signals}),
ls AS (SELECT *, least(100, greatest(0, s)) AS score FROM lg)
"""


def _legacy(t):
    leads = t.signals.select("signal_id", F.col("amount_usd_m").alias("funding"), F.when(F.col("corroborations") > 1, F.col("tags")).otherwise(F.array().cast("array<string>")).alias("signals"),
                             F.col("type").alias("sector"), F.get("competitors", 0).alias("competitor"))
    return reports.legacy_score(leads, _LEGACY_W, ["funding", "launch"], "payment|multi-currency|checkout|status f")


@query("legacy_score", f"WITH {_LEGACY} SELECT signal_id, CAST(score AS BIGINT) AS score FROM ls")
def _(t):
    return _legacy(t).select("signal_id", F.col("score").cast("bigint").alias("score"))


@query("legacy_kpis", f"WITH {_LEGACY} SELECT CAST(count(*) FILTER (WHERE score >= 40) AS BIGINT) AS qualified, CAST(floor(avg(score) + 0.5) AS BIGINT) AS avg_score, CAST(count(amount_usd_m) AS BIGINT) AS funded, CAST(count(*) FILTER (WHERE corroborations > 1) AS BIGINT) AS international FROM ls")
def _(t):
    return reports.legacy_kpis(_legacy(t), 40)
