"""Repeat coverage of one company event.

A new event of a company and type is a repeat of one of the last ten stored ones
when the dates are close and stage, amount, title or url agree.  A merge may fill
the stored event's stage or amount and so change later matches, hence the ordered
scan; everything else is an aggregate over its outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fv
from ..functions.text import token_list
from .fold import scan_in_order
from .merge import first_distinct, first_known

_DAY_US = 86_400_000_000


def _known(v) -> bool:
    return v is not None and v == v


def _amounts_agree(a, b) -> bool:
    if not (_known(a) and _known(b)) or not a or not b:
        return False
    return abs(a - b) / max(a, b) < fv.TWIN_AMOUNT_TOLERANCE


def _titles_agree(a: list, b: list) -> bool:
    x, y = set(a), set(b)
    return bool(x and y) and len(x & y) / len(x | y) >= fv.TWIN_JACCARD


def twin_step(state: dict, row: dict) -> dict:
    """Fold one event into the memory of its (company, type)."""
    memory = state.setdefault("stored", [])
    kind, when = row["type"], row["occurred_us"]
    when = int(when) if _known(when) else None
    stage = row["stage"] if _known(row["stage"]) else None
    amount = float(row["amount_usd_m"]) if _known(row["amount_usd_m"]) else None
    tokens = sorted(set(row["tokens"]))
    days = fv.TWIN_DIRECTORY_DAYS if kind == "directory" else fv.TWIN_DAYS
    twin = None
    for e in reversed(memory):  # newest first
        if e["when"] is None or when is None or abs(e["when"] - when) >= days * _DAY_US:
            continue
        same = kind == "directory"
        if kind == "funding":
            same = bool(e["stage"] and stage and e["stage"] == stage) or _amounts_agree(e["amount"], amount)
        if same or _titles_agree(e["tokens"], tokens) or e["url"] == row["url"]:
            twin = e
            break
    if twin is None:
        memory.append({"id": int(row["signal_id"]), "when": when, "stage": stage, "amount": amount,
                       "tokens": tokens, "url": row["url"], "extra": []})
        del memory[: -fv.TWIN_MEMORY]
        return {"signal_id": int(row["signal_id"]), "stored_id": int(row["signal_id"]), "counted": True}
    counted = twin["url"] != row["url"] and row["url"] not in twin["extra"]
    if counted:
        twin["extra"] = (twin["extra"] + [row["url"]])[-12:]
        twin["stage"] = twin["stage"] or stage
        twin["amount"] = twin["amount"] if twin["amount"] is not None else amount
    return {"signal_id": int(row["signal_id"]), "stored_id": twin["id"], "counted": counted}


def event_twins(signals: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """``signal_id``, ``stored_id``, ``counted``: which stored event each event belongs to.

    ``signals``: signal_id (arrival order), company_id, type, title, url, stage,
    amount_usd_m, occurred_us.
    """
    rows = signals.select(
        "signal_id", "company_id", "type", "url", "stage", "amount_usd_m", "occurred_us",
        token_list(F.col("title")).alias("tokens"))
    return fold_twins(rows, chunk_rows)


def fold_twins(rows: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """`event_twins` of rows that have ``tokens`` in place of the title."""
    extra = {} if chunk_rows is None else {"chunk_rows": chunk_rows}
    rows = rows.select("signal_id", "company_id", "type", "url", "stage", "amount_usd_m", "occurred_us", "tokens")
    return scan_in_order(rows, ["company_id", "type"], ["signal_id"], twin_step,
                         "signal_id long, stored_id long, counted boolean", **extra)


def corroborate(signals: DataFrame, twins: DataFrame) -> DataFrame:
    """Stored events with their corroborations merged in.

    Needs tags and investors arrays on ``signals``.
    """
    j = signals.join(twins.where("counted"), "signal_id")
    o = F.col("signal_id")
    base = j.groupBy("stored_id").agg(
        F.min_by("company_id", o).alias("company_id"), F.min_by("type", o).alias("type"), F.min_by("title", o).alias("title"),
        F.count("*").alias("corroborations"), first_known(F.col("stage"), o).alias("stage"),
        first_known(F.col("amount_usd_m"), o).alias("amount_usd_m"), F.max("confidence").alias("confidence"),
        F.min_by("occurred_us", o).alias("occurred_us"),
    )
    spread = lambda c: j.select("stored_id", F.posexplode(c).alias("pos", "v"), "signal_id").select(
        "stored_id", "v", F.struct("signal_id", "pos").alias("at"))
    tags = first_distinct(spread("tags"), "stored_id", "v", "at", 8, "tags")
    investors = first_distinct(spread("investors"), "stored_id", "v", "at", 8, "investors")
    others = j.where(F.col("signal_id") != F.col("stored_id"))
    last = others.withColumn("rn", F.row_number().over(Window.partitionBy("stored_id").orderBy(F.col("signal_id").desc()))).where("rn <= 12")
    urls = last.groupBy("stored_id").agg(F.array_sort(F.collect_list(F.struct("signal_id", "url"))).alias("u")).select(
        "stored_id", F.transform("u", lambda x: x["url"]).alias("extra_urls"))
    return base.join(tags, "stored_id", "left").join(investors, "stored_id", "left").join(urls, "stored_id", "left")
