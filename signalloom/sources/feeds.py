"""Landing jobs: stored source bodies become items.

Each job maps a table of bodies to the same item shape: source_id, url, title,
summary, published_at and a few source facts.  Rows that cannot be read go to a
quarantine instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip_text, strip_markup
from ..operators.state import once

_ITEM = "struct<link:string,guid:string,title:string,description:string,encoded:string,pubDate:string,date:string,source:string,category:array<string>>"
#: Holds the body when it cannot be parsed as a whole.
CORRUPT = "_corrupt_record"
RSS = f"channel struct<item:array<{_ITEM}>>, {CORRUPT} string"
RDF = f"item array<{_ITEM}>, {CORRUPT} string"
ATOM = (
    "entry array<struct<id:string,title:string,content:string,summary:string,updated:string,published:string,"
    "author:struct<name:string>,link:array<struct<_href:string,_rel:string>>>>"
    f", {CORRUPT} string"
)
SUMMARY_CHARS = 1500


def _xml(body: Column, schema: str) -> Column:
    plain = F.regexp_replace(body, r"<(/?)content:encoded", "<$1encoded")
    plain = F.regexp_replace(plain, r"<(/?)dc:date", "<$1date")
    return F.from_xml(plain, schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "valueTag": "_VALUE"})


def feed_time(text: Column) -> Column:
    """RFC 822 or ISO 8601 text to a timestamp; null when unreadable."""
    iso = F.try_to_timestamp(text)
    bare = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    bare = F.regexp_replace(bare, r"\s(GMT|UTC|Z)$", " +0000")
    rfc = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.when(text.rlike(r"^\d{4}-"), iso).otherwise(rfc)


def _some(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])


def _unreadable(parsed: Column) -> Column:
    """Why a parsed body gives nothing, or null: it is empty, or not well-formed as a whole."""
    return F.when(parsed.isNull(), "empty").when(parsed[CORRUPT].isNotNull(), "malformed")


def land_feeds(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, quarantine) out of source_id, fetched_at, body in RSS, Atom or RDF.

    Each body is parsed with the schema of its own dialect.  A body of no known dialect, and one that is not well-formed to its end,
    is in the quarantine with its ``reason`` and gives no items.
    """
    body = F.coalesce("body", F.lit(""))
    kind = F.when(body.rlike(r"(?i)<rss[\s>]"), "rss").when(body.rlike(r"(?i)<feed[\s>]"), "atom").when(body.rlike(r"(?i)<rdf:RDF[\s>]"), "rdf")
    b = bodies.withColumn("dialect", kind)
    parsed = {d: once(b.where(F.col("dialect") == d), x=_xml(F.col("body"), schema)) for d, schema in (("rss", RSS), ("atom", ATOM), ("rdf", RDF))}
    bad = b.where("dialect IS NULL").select("source_id", "fetched_at", "body", F.lit("unknown dialect").alias("reason"))
    for part in parsed.values():
        broken = part.withColumn("reason", _unreadable(F.col("x"))).where("reason IS NOT NULL")
        bad = bad.unionByName(broken.select("source_id", "fetched_at", "body", "reason"))
    good = {d: part.where(_unreadable(F.col("x")).isNull()) for d, part in parsed.items()}

    def rss_like(part: DataFrame, items: Column) -> DataFrame:
        e = part.select("source_id", "fetched_at", F.explode(items).alias("e"))
        return e.select(
            "source_id", "fetched_at", _some(F.col("e.link"), F.col("e.guid")).alias("url"), strip_markup(F.col("e.title")).alias("title"),
            clip_text(strip_markup(F.coalesce(_some(F.col("e.encoded"), F.col("e.description")), F.lit(""))), SUMMARY_CHARS).alias("summary"),
            feed_time(_some(F.col("e.pubDate"), F.col("e.date"))).alias("published_at"), F.col("e.source").alias("publisher"),
            F.slice(F.coalesce("e.category", F.array().cast("array<string>")), 1, 8).alias("categories"))

    rss = rss_like(good["rss"], F.col("x.channel.item"))
    rdf = rss_like(good["rdf"], F.col("x.item"))
    entries = good["atom"].select("source_id", "fetched_at", F.explode("x.entry").alias("e"))
    main = F.filter("e.link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    atom = entries.select(
        "source_id", "fetched_at", F.coalesce(F.get(main, 0)["_href"], F.get("e.link", 0)["_href"], F.col("e.id")).alias("url"),
        strip_markup(F.col("e.title")).alias("title"),
        clip_text(strip_markup(F.coalesce(_some(F.col("e.content"), F.col("e.summary")), F.lit(""))), SUMMARY_CHARS).alias("summary"),
        feed_time(_some(F.col("e.updated"), F.col("e.published"))).alias("published_at"), F.col("e.author.name").alias("publisher"),
        F.array().cast("array<string>").alias("categories"))
    return rss.unionByName(atom).unionByName(rdf), bad


def land_search_news(items: DataFrame) -> DataFrame:
    """``Headline - Publisher`` titles split, summaries blanked, the query kept."""
    p = r"^(.*)\s+-\s+([^-]{2,60})$"
    hit = F.col("title").rlike(p)
    return items.withColumns({
        "publisher": F.when(hit, F.regexp_extract("title", p, 2)), "title": F.when(hit, F.regexp_extract("title", p, 1)).otherwise(F.col("title")),
        "summary": F.lit("")})


FORUM_DROP = r"(?i)^\[(for hire|hiring|meta|mod)\]"
FORUM_POST = "struct<kind:string,data:struct<permalink:string,title:string,selftext:string,body:string,link_title:string,created_utc:double,subreddit:string,score:int,num_comments:int>>"


_HIT = "struct<objectID:string,title:string,url:string,story_text:string,created_at:string,points:int>"
#: What the bodies of the JSON jobs hold.
JSON_BODIES = {"forum": f"data struct<children:array<{FORUM_POST}>>", "hits": f"hits array<{_HIT}>"}


def unreadable_json(bodies: DataFrame, kind: str) -> DataFrame:
    """The quarantine of `land_forum_posts` (``forum``) and `land_hits_json` (``hits``): bodies that are empty, malformed or of another shape."""
    parsed = once(bodies, x=F.from_json("body", f"{JSON_BODIES[kind]}, {CORRUPT} string"))
    inside = F.col("x.data.children") if kind == "forum" else F.col("x.hits")
    reason = F.coalesce(_unreadable(F.col("x")), F.when(inside.isNull(), "another shape"))
    return parsed.withColumn("reason", reason).where("reason IS NOT NULL").select("source_id", "body", "reason")


def land_forum_posts(bodies: DataFrame, host: str = "https://www.reddit.com") -> DataFrame:
    """Forum listing JSON to posts and comments: hiring and meta titles dropped, comments keep their thread title."""
    kids = F.from_json("body", JSON_BODIES["forum"])["data"]["children"]
    d = bodies.select("source_id", F.explode(kids).alias("k")).select("source_id", "k.data.*")
    comment = F.col("body").isNotNull() & F.col("link_title").isNotNull()
    d = d.withColumn("comment", comment).where(F.col("comment") | (F.col("title").isNotNull() & ~F.coalesce(F.col("title").rlike(FORUM_DROP), F.lit(False))))
    return d.select(
        "source_id", F.concat(F.lit(host), "permalink").alias("url"), F.when(F.col("comment"), F.col("link_title")).otherwise(F.col("title")).alias("title"),
        clip_text(F.coalesce(F.when(F.col("comment"), F.col("body")).otherwise(F.col("selftext")), F.lit("")), SUMMARY_CHARS).alias("summary"),
        F.timestamp_seconds("created_utc").alias("published_at"), F.col("subreddit").alias("channel"), "comment", "score", F.col("num_comments").alias("comments"))


def forum_feed_titles(items: DataFrame) -> DataFrame:
    """Titles of a forum's feed: user names off comment titles, channel headers and hiring posts dropped."""
    t = F.when(F.col("comment"), F.regexp_replace("title", r"^/?u/\S+ on ", "")).otherwise(F.col("title"))
    s = F.when(F.col("comment"), F.col("summary")).otherwise(F.trim(F.regexp_replace("summary", r"(?i)submitted by .*$", "")))
    drop = ~F.col("comment") & (F.col("title").rlike(r"^r/\w+$") | F.col("title").rlike(FORUM_DROP))
    return items.where(~drop).withColumns({"title": t, "summary": clip_text(s, SUMMARY_CHARS)})


def land_hits_json(bodies: DataFrame, as_of: Column, days: int = 30, item_url: str = "https://news.ycombinator.com/item?id=") -> DataFrame:
    """Search-API hits to items: fallback url, title required, not older than ``days``."""
    h = bodies.select("source_id", F.explode(F.from_json("body", JSON_BODIES["hits"])["hits"]).alias("h")).select("source_id", "h.*")
    h = h.withColumn("published_at", F.try_to_timestamp("created_at"))
    fresh = F.col("published_at").isNull() | (F.col("published_at") > as_of - F.make_dt_interval(F.lit(days)))
    return h.where(_some(F.col("title")).isNotNull() & fresh).select(
        "source_id", F.coalesce(_some(F.col("url")), F.concat(F.lit(item_url), "objectID")).alias("url"), "title",
        clip_text(strip_markup(F.coalesce("story_text", F.lit(""))), SUMMARY_CHARS).alias("summary"), "published_at", "points")


DIRECTORY = (
    "name string, url string, website string, small_logo_thumb_url string, all_locations string, one_liner string, long_description string, "
    "industry string, subindustry string, tags array<string>, team_size int, batch string, isHiring boolean, status string, regions array<string>, launched_at long"
)


def land_directory(entries: DataFrame, region: str, min_year: int = 2022) -> DataFrame:
    """Directory records to items with an ``entity`` struct; active ones of a region and recent cohorts."""
    year = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("batch", F.lit("")), r"\d{4}", 0), F.lit("")).cast("int"), F.lit(0))
    e = entries.where(F.coalesce(F.array_contains("regions", region), F.lit(False)) & (F.col("status") == "Active") & (year >= min_year))
    industry = F.concat_ws(" / ", F.nullif("industry", F.lit("")), F.nullif("subindustry", F.lit("")), "tags")
    return e.select(
        "url", F.trim(F.concat(F.col("name"), F.lit(" ("), F.col("batch"), F.lit("): "), F.coalesce("one_liner", F.lit("")))).alias("title"),
        clip_text(F.coalesce(_some(F.col("long_description")), _some(F.col("one_liner")), F.lit("")), 1200).alias("summary"),
        F.timestamp_seconds("launched_at").alias("published_at"),
        F.struct(
            "name", "website", F.col("small_logo_thumb_url").alias("logo"), _some(F.split("all_locations", ",")[0]).alias("city"),
            F.col("one_liner").alias("description"), industry.alias("industry"), "team_size", "batch",
            F.coalesce("isHiring", F.lit(False)).alias("hiring"), F.lit("Seed").alias("stage")).alias("entity"))
