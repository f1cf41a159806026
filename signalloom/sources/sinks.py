"""Exports, imports and versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_money

CSV_COLUMNS = [
    "name", "score", "sector", "city", "website", "status", "stage", "amount", "funding_date", "team_size", "contact_name",
    "contact_role", "contact_email", "email_status", "reach_out_to", "markets", "signals", "payment_stack", "why", "pitch", "source_url",
]
CSV_ROWS = 5000  # the sheet holds the first 5000 leads of the chosen order


def lead_sheet(view: DataFrame, order: list[Column], rows: int = CSV_ROWS) -> DataFrame:
    """The flat sheet of a lead view: text in every column, arrays joined."""
    have = set(view.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    arr = lambda c, sep: F.array_join(c, sep) if c in have else F.lit(None).cast("string")
    out = {c: col(c) for c in CSV_COLUMNS}
    out.update({
        "stage": F.col("funding.stage"), "amount": format_money(F.col("funding.amount_usd_m")),
        "funding_date": F.date_format("funding.occurred_at", "yyyy-MM-dd"), "reach_out_to": arr("roles", " / "),
        "markets": arr("markets", "; "), "signals": arr("signals", "; "), "payment_stack": arr("providers", "; "), "source_url": F.col("latest.url"),
    })
    top = view.orderBy(*order).limit(rows)
    return top.select(*[F.coalesce(out[c].cast("string"), F.lit("")).alias(c) for c in CSV_COLUMNS])


def csv_line() -> Column:
    """One quoted line of the sheet, quotes doubled."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) for c in CSV_COLUMNS])


def export_leads_csv(sheet: DataFrame, path: str) -> None:
    """Write the sheet; it is at most ``CSV_ROWS`` rows, so one file."""
    sheet.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


LEAD_RECORD = (
    "id string, company string, sector string, score int, funding struct<amount:string,stage:string,date:string,investors:array<string>>, "
    "signals array<string>, why string, website string, source string, sourceTitle string, date date, competitor string"
)


def import_leads_json(spark: SparkSession, path: str) -> DataFrame:
    """Lead records out of files holding an array or ``{"leads": [...]}``."""
    raw = spark.read.option("multiLine", True).schema(f"leads array<struct<{_nested(LEAD_RECORD)}>>, {LEAD_RECORD}").json(path)
    plain = raw.where(F.col("leads").isNull() & F.col("company").isNotNull()).drop("leads")
    wrapped = raw.where(F.col("leads").isNotNull()).select(F.inline("leads"))
    return plain.unionByName(wrapped)


def _nested(ddl: str) -> str:
    """Top-level ``a t, b t`` as struct fields ``a:t,b:t``."""
    out, depth, part = [], 0, ""
    for ch in ddl + ",":
        if ch == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            part = ""
            continue
        depth += (ch == "<") - (ch == ">")
        part += ch
    return ",".join(out)


def write_version(df: DataFrame, root: str, version: int) -> str:
    """Write one immutable version of a derived table; re-running a version replaces only itself."""
    path = f"{root.rstrip('/')}/version={version:010d}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of a table, by default the newest complete one.

    A version counts once Spark's ``_SUCCESS`` marker stands in it, so a job that
    died half-way never becomes visible.
    """
    if version is None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        base = hadoop.Path(root)
        fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = fs.globStatus(hadoop.Path(f"{root.rstrip('/')}/version=*/_SUCCESS"))
        version = max(int(s.getPath().getParent().getName().split("=")[1]) for s in done)
    return spark.read.parquet(f"{root.rstrip('/')}/version={version:010d}")
