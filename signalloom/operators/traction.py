"""Search-traffic payloads: by country, over time, by keyword and technology, and what they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_packs as fp
from ..functions.numeric import round_half_up
from ..functions.regex import matches
from .ranking import per_key


def traction_totals(metrics: DataFrame) -> DataFrame:
    """Per company: total and paid traffic, keywords, number of countries with ads."""
    return metrics.groupBy("company_id").agg(
        F.sum("etv").alias("total"), F.sum("keywords").alias("keywords"), F.count(F.when(F.col("paid_count") > 0, 1)).alias("paid_countries"))


def traction_countries(metrics: DataFrame, home: str) -> DataFrame:
    """Per company and country: traffic, keywords, main language by traffic, share; plus the foreign share.

    ``metrics``: company_id, country, language, etv, keywords, paid_count; one row per location and language.
    """
    by = metrics.groupBy("company_id", "country").agg(
        F.sum("etv").alias("etv"), F.sum("keywords").alias("keywords"), F.max_by("language", F.struct("etv", "language")).alias("language"))
    total = by.groupBy("company_id").agg(F.sum("etv").alias("total"), F.sum(F.when(F.col("country") == home, F.col("etv")).otherwise(0.0)).alias("home_etv"))
    j = by.join(total, "company_id")
    share = F.when(F.col("total") != 0, F.col("etv") / F.col("total")).otherwise(0.0)
    foreign = F.when(F.col("total") != 0, 1.0 - F.col("home_etv") / F.col("total"))
    return j.withColumn("share", share).withColumn("foreign_share", foreign).drop("home_etv")


def traction_trend(history: DataFrame, months: int = 12, floor: float = 20.0) -> DataFrame:
    """Last ``months`` per company with growth over three months (null below the base floor).

    ``history``: company_id, month (sortable), etv; one row per month.
    """
    last = per_key(history, ["company_id"], [F.desc("month")], months)
    w = Window.partitionBy("company_id").orderBy("month")
    base = F.lag("etv", 3).over(w)
    return last.withColumn("growth", F.when(base > floor, (F.col("etv") - base) / base)).drop("rn")


def traction_keywords(keywords: DataFrame, n: int = 10) -> DataFrame:
    """Top keywords by estimated traffic."""
    return per_key(keywords.where(F.col("keyword").isNotNull()), ["company_id"], [F.desc("etv"), F.col("keyword").asc()], n)


def traction_tech(payloads: DataFrame, others: int = 14) -> DataFrame:
    """Technologies split into payment, commerce and the first other names.

    ``payloads``: company_id, technologies map<group, map<category, array<name>>>.
    """
    flat = payloads.select("company_id", F.posexplode(F.map_entries("technologies")).alias("g", "ge"))
    flat = flat.select("company_id", "g", F.posexplode(F.map_entries("ge.value")).alias("c", "ce"))
    flat = flat.select("company_id", "g", "c", F.col("ce.key").alias("category"), F.posexplode("ce.value").alias("i", "name"))
    pay, shop = matches(F.col("name"), fp.PAYMENT_TECH), matches(F.col("name"), fp.COMMERCE_TECH)
    one = flat.groupBy("company_id", "name").agg(
        F.min(F.struct("g", "c", "i")).alias("at"), F.max(pay | matches(F.col("category"), "payment")).alias("is_pay"),
        F.max(shop | matches(F.col("category"), "ecommerce")).alias("is_shop"), F.max(~pay & ~shop).alias("is_other"))
    w = Window.partitionBy("company_id").orderBy(F.desc("is_other"), "at")
    one = one.withColumn("rn", F.row_number().over(w))
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("at", "name")))), lambda x: x["name"])
    return one.groupBy("company_id").agg(
        pick(F.col("is_pay")).alias("payments"), pick(F.col("is_shop")).alias("commerce"), pick(F.col("is_other") & (F.col("rn") <= others)).alias("other"))


def traction_insights(d: DataFrame) -> DataFrame:
    """Adds ``notes`` array<struct<tone,text>>.

    ``d``: total, foreign_share, top_foreign, months, growth, paid_countries, payments, commerce.
    """
    pct = lambda x: F.concat(round_half_up(x * 100).cast("string"), F.lit("%"))
    note = lambda tone, *t: F.struct(F.lit(tone).alias("tone"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in t]).alias("text"))
    led = F.coalesce(F.concat(F.lit(", led by "), F.col("top_foreign")), F.lit(""))
    share = F.col("foreign_share")
    enough = share.isNotNull() & (F.col("total") >= 50)
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    notes = F.array_compact(F.array(
        F.when(enough, F.when(share >= 0.5, note("good", pct(share), " of search traffic is foreign", led))
               .when(share >= 0.15, note("good", pct(share), " of search traffic is international"))
               .otherwise(note("neutral", "Search traffic is mostly domestic (", pct(1.0 - share), ")"))),
        F.when((F.col("months") >= 4) & (F.col("growth") >= 0.2), note("good", "Traffic grew ", pct(F.col("growth")), " over 3 months"))
        .when((F.col("months") >= 4) & (F.col("growth") <= -0.2), note("warn", "Traffic fell ", pct(-F.col("growth")), " over 3 months")),
        F.when(F.col("paid_countries") > 0, note("good", "Buys search ads in ", F.col("paid_countries").cast("string"), " markets")),
        F.when(some("payments"), note("neutral", "Payment stack: ", F.array_join("payments", ", ")))
        .when(some("commerce"), note("neutral", "Runs on ", F.array_join("commerce", ", "), " without a payment provider"))))
    none = F.array(note("neutral", "Too little search data to judge traction"))
    return d.withColumn("notes", F.when(F.size(notes) > 0, notes).otherwise(none))


# ---------------------------------------------------------------- firmographics
FIELDS = {
    "name": ["company_name", "companyName", "name"],
    "website": ["website", "domain", "company_domain", "companyDomain"],
    "linkedin": ["linkedin_url", "linkedinUrl", "company_linkedin_url", "linkedin"],
    "industry": ["industry", "industries"],
    "description": ["description", "company_description", "companyDescription", "about"],
    "hq": ["hq_location", "headquarters", "location", "hq", "company_location", "country"],
    "business_type": ["business_type", "businessType"],
    "funding_stage": ["funding.stage", "funding_stage", "fundingStage", "last_funding_stage", "last_funding_type"],
    "last_funding_date": ["funding.last_funding_date", "last_funding_date", "lastFundingDate"],
}
NUMBERS = {
    "employees": ["employee_count", "employeeCount", "employees", "headcount", "company_size"],
    "revenue": ["revenue", "annual_revenue", "annualRevenue", "revenue_range"],
    "founded": ["founded_year", "foundedYear", "founded"],
    "total_funding": ["funding.total_funding", "total_funding", "totalFunding"],
    "open_jobs": ["job_openings_count", "open_jobs", "jobOpenings", "job_openings.count"],
}
LISTS = {"technologies": ["technologies", "technology", "tech_stack", "techStack"]}
COUNTRIES = ["employee_distribution", "employeeDistribution", "employees_by_country", "employee_countries", "country_distribution"]


def _pick(keys: list[str]) -> Column:
    """Text of the first present, non-empty key."""
    return F.coalesce(*[F.when(~F.coalesce(F.get_json_object("raw", f"$.{k}"), F.lit("")).isin("", "[]", "null"), F.get_json_object("raw", f"$.{k}")) for k in keys])


def _number(text: Column) -> Column:
    """A plain number, or the max, min or value of an object."""
    inner = F.coalesce(*[F.get_json_object(text, f"$.{k}") for k in ("max", "min", "value")])
    return F.coalesce(text.try_cast("double"), inner.try_cast("double"))


def _list(text: Column) -> Column:
    """A JSON array of texts or objects, or delimited text."""
    as_array = F.from_json(F.when(text.startswith("["), text), "array<string>")
    named = F.transform(as_array, lambda x: F.when(x.startswith("{"), F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in ("name", "title", "value")])).otherwise(x))
    split = F.filter(F.split(text, r"\s*[,;|]\s*"), lambda x: x != "")
    return F.array_compact(F.coalesce(named, split, F.array().cast("array<string>")))


def normalise_firmographics(payloads: DataFrame) -> DataFrame:
    """company_id, raw (JSON text with loose keys) to one fixed record."""
    dist = _pick(COUNTRIES)
    row = "array<struct<country:string,name:string,country_name:string,employees:string,count:string,employee_count:string>>"
    from_list = F.transform(F.from_json(F.when(dist.startswith("["), dist), row), lambda x: F.struct(
        F.coalesce(x["country"], x["name"], x["country_name"]).alias("country"),
        _number(F.coalesce(x["employees"], x["count"], x["employee_count"])).alias("employees")))
    from_map = F.transform(F.map_entries(F.from_json(F.when(dist.startswith("{"), dist), "map<string,string>")), lambda e: F.struct(
        e["key"].alias("country"), _number(e["value"]).alias("employees")))
    empty = F.array().cast("array<struct<country:string,employees:double>>")
    countries = F.filter(F.coalesce(from_list, from_map, empty), lambda x: x["country"].isNotNull())
    ordered = F.transform(
        F.array_sort(F.transform(countries, lambda x: F.struct((-F.coalesce(x["employees"], F.lit(0.0))).alias("k"), x["country"].alias("country"), x["employees"].alias("employees")))),
        lambda x: F.struct(x["country"].alias("country"), x["employees"].alias("employees")))
    return payloads.select(
        "company_id", *[_pick(v).alias(k) for k, v in FIELDS.items()], *[_number(_pick(v)).alias(k) for k, v in NUMBERS.items()],
        *[F.slice(_list(_pick(v)), 1, 30).alias(k) for k, v in LISTS.items()], F.slice(ordered, 1, 10).alias("countries"))
