"""Event twins as keyed streaming state: one key per company with an entry per type, whose cost does not grow with history."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import fixed_values as fv
from ..functions.text import token_list
from ..operators.twins import twin_step

_DAY_MS = 86_400_000
#: Events of a key that stay open for late arrivals.
HISTORY = 64
EVENT = "signal_id long, url string, stage string, amount_usd_m double, occurred_us long, tokens array<string>"
FIELDS = [f.split()[0] for f in EVENT.split(", ")]
KEYS = ["company_id", "type"]
_DIRECTORY = json.dumps("directory")
_OUT = Row("company_id", "type", *FIELDS, "stored_id", "counted", "beyond")
OUTPUT = f"company_id long, type string, {EVENT}, stored_id long, counted boolean, beyond boolean"


def fold(kind: str, memory: dict, recent: list[dict], new: list[dict], history: int) -> tuple[list[dict], dict, list[dict]]:
    """(verdicts from the first new event on, memory before the events that stay open, these events).

    ``memory`` is the twin memory before ``recent``, the key's last events in order; ``new`` may lie among them.
    """
    new = sorted(new, key=lambda e: e["signal_id"])
    events = sorted([*recent, *new], key=lambda e: e["signal_id"])
    closed = max(0, len(events) - history)
    out, kept = [], memory if closed == 0 else None
    state = json.loads(json.dumps(memory))
    for i, e in enumerate(events):
        verdict = twin_step(state, {**e, "type": kind})
        if e["signal_id"] >= new[0]["signal_id"]:
            out.append({**e, **verdict})
        if i + 1 == closed:
            kept = json.loads(json.dumps(state))
    return out, kept, events[closed:]


class TwinState(StatefulProcessor):
    """Per company and type: the twin memory, the last ``history`` events behind it, and where these begin.

    A company's types are read and written together, since a call to the state costs more than the judging of an event.
    An event that comes late but among the open ones is folded in at its place and those behind it are judged again.  One from before
    is passed on as ``beyond``, and so are all later events of its company and type, to be judged from the log.  What is held of a type is forgotten
    30 days after its last event (directories: never); a type that comes back then is ``beyond`` too, so nothing is
    judged from a memory that is gone.
    """

    def __init__(self, history: int = HISTORY, ttl_days: int = fv.TWIN_DAYS):
        self.history, self.ttl = history, ttl_days * _DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Types that have been seen, and whether they are beyond; by type (as JSON, for null) what is held, without and with directories.
        self.place = handle.getValueState("place", "json string")
        self.held = {False: handle.getValueState("held", "json string", ttlDurationMs=self.ttl), True: handle.getValueState("directory", "json string")}

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        company = int(key[0]) if key[0] else None
        new: dict[str, list[dict]] = {}
        for r in rows:
            new.setdefault(json.dumps(r["type"]), []).append({f: r[f] for f in FIELDS})
        now = timer_values.getCurrentProcessingTimeInMs()
        place = json.loads((self.place.get() or ("{}",))[0])
        before = dict(place)
        for lasting in sorted({t == _DIRECTORY for t in new}):
            state = self.held[lasting].get() if before else None
            held = json.loads(state[0]) if state else {}
            if not lasting:
                held = {t: x for t, x in held.items() if x["seen"] + self.ttl > now}
            for t in [t for t in new if (t == _DIRECTORY) == lasting]:
                kind = json.loads(t)
                x = held.pop(t, None if t in before else {"floor": None, "memory": {}, "recent": []})
                if x is None or before.get(t) or x["floor"] is not None and min(e["signal_id"] for e in new[t]) <= x["floor"]:
                    place[t] = True
                    for e in new[t]:
                        yield _OUT(company, kind, *(e[f] for f in FIELDS), None, None, True)
                    continue
                out, memory, opened = fold(kind, x["memory"], x["recent"], new[t], self.history)
                closed = [e["signal_id"] for e in x["recent"] + new[t] if e["signal_id"] < opened[0]["signal_id"]]
                held[t] = {"floor": max(closed, default=x["floor"]), "memory": memory, "recent": opened, "seen": now}
                place[t] = False
                for e in out:
                    yield _OUT(company, kind, *(e[f] for f in FIELDS), e["stored_id"], e["counted"], False)
            if held:
                self.held[lasting].update((json.dumps(held),))
            elif state:
                self.held[lasting].clear()
        if place != before:
            self.place.update((json.dumps(place),))

    def close(self) -> None:
        pass


def judged(signals: DataFrame, history: int = HISTORY, ttl_days: int = fv.TWIN_DAYS) -> DataFrame:
    """A stream of verdicts, newest ones of an event hold; ``beyond`` rows have none yet."""
    rows = signals.select(
        F.col("company_id").cast("long").alias("company_id"), F.col("type"), F.col("signal_id").cast("long").alias("signal_id"), "url", "stage",
        F.col("amount_usd_m").cast("double").alias("amount_usd_m"), F.col("occurred_us").cast("long").alias("occurred_us"), token_list(F.col("title")).alias("tokens"),
    )
    # Keys of state must not be null.
    key = F.coalesce(F.col("company_id").cast("string"), F.lit(""))
    return rows.withColumn("key", key).groupBy("key").transformWithState(TwinState(history, ttl_days), OUTPUT, "Append", "ProcessingTime")
