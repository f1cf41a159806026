"""Facts out of stored web pages.  Everything is a scan over ``html`` with regex expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_packs as fp
from ..functions import fixed_values as fv
from ..functions.packs import RulePack
from ..functions.regex import ascii_regex, edged, extract, let, matches
from ..functions.text import canonical_url, clip_text, collapse_space, decode_entities, domain_of, norm_name
from .state import once

PROVIDERS = RulePack.of(fp.SITE_PROVIDERS)
PLATFORMS = RulePack.of(fp.SITE_PLATFORMS)
_NONE = "array<string>"
#: Characters of a company's key by which pages are looked up; what is left of a long key has as many at least.
GRAM = 6


def _tags_off(html: Column) -> Column:
    return collapse_space(decode_entities(F.regexp_replace(html, r"<[^>]*>", " ")))


def body_text(html: Column) -> Column:
    """Text of the body, tags spaced apart, without scripts, styles and comments."""
    body = F.coalesce(extract(html, r"(?s)<body\b[^>]*>.*", 0), html)
    s = F.regexp_replace(body, r"(?is)<(script|style)\b.*?</\1>", " ")
    return _tags_off(F.regexp_replace(s, r"(?s)<!--.*?-->", " "))


def page_text(html: Column) -> Column:
    """Main text: article or main paragraphs when they say enough, else the body without its chrome."""
    s = F.regexp_replace(html, r">\s*<", "> <")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?is)<(script|style|noscript|svg|nav|footer|header|form|iframe)\b.*?</\1>", " ")
    main = F.array_join(F.regexp_extract_all(s, F.lit(r"(?is)<(?:article|main)\b[^>]*>(.*?)</(?:article|main)>"), F.lit(1)), " ")
    paras = F.array_join(F.regexp_extract_all(main, F.lit(r"(?is)<p\b[^>]*>(.*?)(?:</p>|(?=<p\b)|$)"), F.lit(1)), " ")
    text = _tags_off(paras)
    body = F.coalesce(extract(s, r"(?s)<body\b[^>]*>.*", 0), s)
    return F.when(F.length(text) > 400, text).otherwise(_tags_off(body))


def links(html: Column) -> Column:
    """array<struct<href,label>> of anchors."""
    p = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]*)[^>]*>(.*?)</a>"""
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(p), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(p), F.lit(2)).alias("label"))
    return F.transform(both, lambda z: F.struct(z["href"].alias("href"), F.trim(F.regexp_replace(z["label"], r"<[^>]*>", " ")).alias("label")))


def absolute(href: Column, base: Column) -> Column:
    """Resolve a link against its page (absolute, scheme-relative, rooted or relative)."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    folder = F.when(folder.rlike(r"^[a-z]+://$") | (folder == ""), F.concat(origin, F.lit("/"))).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | href.startswith("#"), F.lit(None).cast("string"))
        .otherwise(F.concat(folder, href))
    )


def about_links(pages: DataFrame, n: int = 2) -> DataFrame:
    """page_id, urls: same-host links to about or team pages, team-like first, else two defaults."""
    found = pages.select("page_id", "url", F.posexplode(links(F.col("html"))).alias("pos", "a"))
    found = found.where(matches(F.concat_ws(" ", "a.href", "a.label"), fp.SITE_ABOUT))
    full = F.regexp_replace(absolute(F.col("a.href"), F.col("url")), r"[?#].*$", "")
    found = found.select("page_id", "url", "pos", full.alias("link"))
    path = F.regexp_extract("link", r"^[a-z]+://[^/]+(.*)$", 1)
    found = found.where((domain_of(F.col("link")) == domain_of(F.col("url"))) & (F.length(path) > 1) & ~matches(path, r"\.(pdf|jpg|png)$"))
    team = F.when(matches(F.col("link"), fp.SITE_TEAM), 0).otherwise(1)
    first = found.groupBy("page_id", "link").agg(F.min("pos").alias("pos")).withColumn("team", team)
    best = first.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("team", "pos", "link"))), 1, n).alias("l"))
    origin = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1)
    default = F.array(F.concat(origin, F.lit("/about")), F.concat(origin, F.lit("/about-us")))
    return pages.select("page_id", "url").join(best, "page_id", "left").select(
        "page_id", F.coalesce(F.transform("l", lambda x: x["link"]), default).alias("urls"))


def job_board(html: Column) -> Column:
    """struct(board, slug) of the first applicant-tracking link, or null."""
    whole = extract(html, fp.JOB_BOARDS, 0)
    g = [extract(whole, fp.JOB_BOARDS, i) for i in (1, 2, 3)]
    board = F.when(g[0].isNotNull(), "greenhouse").when(g[1].isNotNull(), "lever").when(g[2].isNotNull(), "ashby")
    return F.when(whole.isNotNull(), F.struct(board.alias("board"), F.coalesce(*g).alias("slug")))


def job_board_refs(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(F.array_compact(F.array(job_board(F.col("html"))))).alias("j")).select("page_id", "j.board", "j.slug")


def intl_roles(openings: DataFrame, recent_hiring: DataFrame, as_of: Column, per_board: int = 12) -> DataFrame:
    """One hiring event per company whose first openings include roles abroad, at most monthly.

    ``openings``: company_id, pos, title.  ``recent_hiring``: company_id, created_at.
    """
    from .ranking import per_key

    head = per_key(openings, ["company_id"], [F.col("pos").asc()], per_board)
    abroad = head.where(matches(F.col("title"), fp.INTERNATIONAL_ROLE))
    ev = abroad.groupBy("company_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("t"))
    recent = recent_hiring.where(F.col("created_at") > as_of - F.expr("INTERVAL 30 DAYS")).select("company_id")
    return ev.join(recent, "company_id", "left_anti").select(
        "company_id", F.lit("hiring").alias("type"),
        F.concat(F.lit("Hiring for international roles ("), F.col("n").cast("string"), F.lit(" open)")).alias("title"),
        F.array_join(F.transform(F.slice("t", 1, 4), lambda x: x["title"]), "; ").alias("summary"))


# ---------------------------------------------------------------- fingerprint
def parked_filter(pages: DataFrame) -> DataFrame:
    """Drop parked and for-sale pages; the notice stands at the top of the page by definition."""
    return pages.where(~matches(F.substring("html", 1, fp.SITE_PARKED_WINDOW), fp.SITE_PARKED))


def site_fingerprint(pages: DataFrame, providers: RulePack = PROVIDERS, platforms: RulePack = PLATFORMS) -> DataFrame:
    """Per page: title, description, providers, platform, currencies, switcher, ships_abroad, locales,
    social links, role inboxes and the pricing link."""
    html = F.col("html")
    p = once(pages, _text=body_text(html), _links=links(html))
    text = F.col("_text")
    attr = lambda name, prop: extract(html, rf"(?s)<meta\b[^>]*\b{name}=[\"']{prop}[\"'][^>]*\bcontent=[\"']([^\"']*)", 1)
    title = F.coalesce(F.nullif(F.trim(decode_entities(extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1))), F.lit("")), attr("property", "og:site_name"), F.lit(""))
    desc = F.coalesce(attr("name", "description"), attr("property", "og:description"), F.lit(""))
    money = edged(text, lambda *rs: F.array_compact(F.array(*[F.when(text.rlike(r), F.lit(k)) for k, r in zip(fp.SITE_CURRENCIES, rs)])), *fp.SITE_CURRENCIES.values())
    first_link = lambda r: F.get(F.filter("_links", lambda a: a["href"].rlike(r)), 0)["href"]
    locales = F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*\bhreflang=[\"']([^\"']*)"), F.lit(1))), 1, 20)
    mails = F.regexp_extract_all(F.lower(html), F.lit(ascii_regex(fp.SITE_ROLE_INBOX)), F.lit(0))
    return p.select(
        "page_id", "url", domain_of(F.col("url")).alias("domain"), clip_text(title, 120).alias("title"), clip_text(desc, 300).alias("description"),
        providers.all(html).alias("providers"), platforms.first(html).alias("platform"), money.alias("currencies"),
        matches(html, fp.SITE_SWITCHER).alias("switcher"), matches(text, fp.SITE_SHIPS_ABROAD).alias("ships_abroad"), locales.alias("locales"),
        F.struct(
            F.regexp_replace(first_link(r"(?i)linkedin\.com/company/"), r"\?.*$", "").alias("linkedin"),
            first_link(r"(?i)(twitter|x)\.com/[A-Za-z0-9_]+/?$").alias("twitter"),
            first_link(r"(?i)instagram\.com/[A-Za-z0-9_.]+/?$").alias("instagram")).alias("social"),
        F.slice(F.array_distinct(mails), 1, 3).alias("inboxes"),
        absolute(first_link(r"(?i)/pricing(?![A-Za-z0-9_])|/plans(?![A-Za-z0-9_])"), F.col("url")).alias("pricing_url"),
    )


def merge_pricing_page(prints: DataFrame) -> DataFrame:
    """Per domain the union of its pages' providers and currencies, and any switcher.

    A page becomes a row of its own and one per value, and these are counted per (domain, value) first: pages are read once, and a
    domain with very many pages combines before the shuffle.
    """
    kind = lambda k, v, switcher: F.struct(F.lit(k).alias("kind"), v.alias("v"), switcher.alias("switcher"))
    no_value, no_switcher = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    none = F.array().cast(_NONE)
    values = lambda c: F.transform(F.coalesce(c, none), lambda v: kind(c, v, no_switcher))
    found = once(prints.where("domain IS NOT NULL").select("domain", "switcher", "providers", "currencies"), found=F.concat(
        F.array(kind("page", no_value, F.col("switcher"))), values("providers"), values("currencies")))
    rows = found.select("domain", F.explode("found").alias("f")).groupBy("domain", "f.kind", "f.v").agg(
        F.max("f.switcher").alias("switcher"), F.count("*").alias("n"))
    union_of = lambda c: F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.col("v")))).alias(c)
    pages = F.sum(F.when(F.col("kind") == "page", F.col("n"))).alias("pages")
    return rows.groupBy("domain").agg(F.max("switcher").alias("switcher"), pages, union_of("providers"), union_of("currencies"))


def name_matches(name: Column, title: Column, description: Column, text: Column) -> Column:
    """The page speaks of the company: its key, or the first three quarters of a long key, occurs."""
    n = norm_name(name)
    return (n != "") & F.contains(_hay(title, description, text), let(n, _needle))


def _needle(norm: Column) -> Column:
    """What a page must hold of a company's key: the first three quarters of a long one; null for an empty one."""
    part = F.substring(norm, F.lit(1), F.ceil(F.length(norm) * 0.75).cast("int"))
    return F.when(F.length(norm) > 6, part).when(norm != "", norm)


def _hay(title: Column, description: Column, text: Column) -> Column:
    return F.concat(norm_name(F.concat_ws(" ", title, description)), norm_name(F.substring(text, 1, 1500)))


def candidate_domains(companies: DataFrame, n: int | None = 6, shapes=fv.DOMAIN_SHAPES) -> DataFrame:
    """company_id, name, pos, domain: guesses from the name by ``shapes``, best first, the first ``n`` (None: all)."""
    slug = F.regexp_replace(F.replace(F.lower("name"), F.lit("&"), F.lit("and")), "[^a-z0-9]+", "")
    stem = {"slug": slug, "core": norm_name(F.col("name"))}
    guesses = F.array_distinct(F.array(*[F.concat(F.lit(before), stem[of], F.lit(after)) for before, of, after in shapes]))
    return companies.select("company_id", "name", F.posexplode(guesses if n is None else F.slice(guesses, 1, n)).alias("pos", "domain"))


def match_site_to_name(candidates: DataFrame, prints: DataFrame) -> DataFrame:
    """company_id, page_id: the first candidate domain whose page names the company.

    ``candidates``: company_id, name, pos, domain.  ``prints``: page_id, domain, title, description, text.
    A page names a company if it holds one word, the company's `_needle` (as `name_matches` has it).  Needles and pages are normalised
    once; equal ones of a domain are compared once, and only if the page holds the needle's first ``GRAM`` characters.
    """
    named = once(candidates, needle=let(norm_name(F.col("name")), _needle)).where("needle IS NOT NULL")
    wanted = named.select("domain", "needle").distinct().withColumn("key", F.when(F.length("needle") >= GRAM, F.left("needle", F.lit(GRAM))).otherwise(""))
    pages = once(prints.where("domain IS NOT NULL"), hay=_hay(F.col("title"), F.col("description"), F.col("text"))).where("hay IS NOT NULL")
    pages = pages.groupBy("domain", "hay").agg(F.min(F.struct("page_id")).alias("page"))
    # Needles shorter than a key are compared with all pages of the domain.
    keys = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("hay") - GRAM)), lambda i: F.substring(F.col("hay"), i + 1, F.lit(GRAM)))))
    hits = wanted.join(pages.select("domain", "hay", "page", F.explode(keys).alias("key")), ["domain", "key"]).where(F.contains("hay", F.col("needle")))
    first = hits.groupBy("domain", "needle").agg(F.min("page").alias("page"))
    return named.join(first, ["domain", "needle"]).groupBy("company_id").agg(F.min_by("page.page_id", F.struct("pos", "page")).alias("page_id"))


# ---------------------------------------------------------------- structured metadata
_LD = (
    "struct<founder:string,founders:string,numberOfEmployees:string>"
)


def site_metadata(pages: DataFrame) -> DataFrame:
    """page_id, founders array<string>, team struct(min,max,exact) out of JSON-LD blocks."""
    block = r"(?is)<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
    ld = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(block), F.lit(1))).alias("pos", "raw"))
    graph = F.get_json_object("raw", "$.@graph")
    nodes = F.coalesce(F.from_json(graph, "array<string>"), F.from_json(F.when(F.ltrim("raw").startswith("["), F.col("raw")), "array<string>"), F.array("raw"))
    n = ld.select("page_id", "pos", F.posexplode(nodes).alias("npos", "node"))
    founder = F.coalesce(F.get_json_object("node", "$.founder"), F.get_json_object("node", "$.founders"))
    many = F.coalesce(F.from_json(F.when(founder.startswith("["), founder), "array<string>"), F.array(founder))
    emp = F.get_json_object("node", "$.numberOfEmployees")
    value = F.coalesce(F.expr("try_cast(get_json_object(node, '$.numberOfEmployees.value') AS INT)"), F.expr("try_cast(get_json_object(node, '$.numberOfEmployees') AS INT)"))
    low = F.expr("try_cast(get_json_object(node, '$.numberOfEmployees.minValue') AS INT)")
    high = F.expr("try_cast(get_json_object(node, '$.numberOfEmployees.maxValue') AS INT)")
    team = F.when(value > 0, F.struct(value.alias("min"), value.alias("max"), F.lit(True).alias("exact"))).when(
        low > 0, F.struct(low.alias("min"), F.coalesce(high, low * 2).alias("max"), F.lit(False).alias("exact")))
    names = F.array_compact(F.transform(many, lambda f: F.get_json_object(f, "$.name")))
    rows = n.select("page_id", F.struct("pos", "npos").alias("at"), names.alias("names"), team.alias("team"))
    # A page holds a handful of blocks; the last stated team wins.
    return rows.groupBy("page_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "names"))), lambda x: x["names"])).alias("founders"),
        F.max_by("team", F.when(F.col("team").isNotNull(), F.col("at"))).alias("team"))
