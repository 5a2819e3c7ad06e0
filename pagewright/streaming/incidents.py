"""Incidents as one state machine over a stream of judgements and of what people do about them.

An event of a key is a finding (with a rank, lower is worse), a clean judgement, a snooze (until a time) or an acceptance.
Events wait in the key's list until the watermark has passed them and are then taken in order of time, so the result
does not depend on how the stream was cut into batches. What is due by time alone (a snooze that ends, an incident that is no
longer judged, a closed one that is forgotten) is a timer, run in its place among the events.

Steps: opened; baseline (a finding at the first judgement of a key: known, not new); escalated (worse than before);
snoozed; woke (the snooze ended, nothing got worse) or escalated (it did, said when the snooze ends); accepted (closed until it is
worse than accepted or was clean once); resolved; lapsed (not judged for idle).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

NONE = 99  # a rank that nothing has
_KINDS = {"boolean": BooleanType(), "int": IntegerType(), "long": LongType(), "string": StringType()}


def _schema(**columns: str) -> StructType:
    """A schema, made without a session: workers have none."""
    return StructType([StructField(name, _KINDS[kind]) for name, kind in columns.items()])


STATE = _schema(open="boolean", rank="int", opened="long", last="long", quiet="boolean", known="boolean", snoozed="long", asleep="int", accepted="int")
WAITING = _schema(at="long", action="string", rank="int", until="long")
_DAY = 86_400_000_000

State = dict[str, Any]
Step = tuple[int, str, bool]


def fresh() -> State:
    return {"open": False, "rank": NONE, "opened": 0, "last": 0, "quiet": False, "known": False, "snoozed": 0, "asleep": NONE, "accepted": NONE}


def _closed(s: State, **more: Any) -> None:
    s.update({**fresh(), "known": s["known"], "last": s["last"], **more})


def deadline(s: State, idle: int, forget: int) -> tuple[int, str] | None:
    """When something is due without an event, and what."""
    if not s["known"]:
        return None
    due = [(s["last"] + idle, "lapse")] if s["open"] else [(s["last"] + forget, "forget")]
    return min(due + ([(s["snoozed"], "wake")] if s["snoozed"] else []))


def run_due(s: State, to: int, idle: int, forget: int) -> list[Step]:
    """Runs what is due up to a time, in order."""
    out: list[Step] = []
    while (due := deadline(s, idle, forget)) and due[0] <= to:
        at, what = due
        if what == "wake":
            out.append((at, "escalated" if s["rank"] < s["asleep"] else "woke", s["quiet"]))
            s.update(snoozed=0, asleep=NONE)
        elif what == "lapse":
            out.append((at, "lapsed", s["quiet"]))
            _closed(s, last=at)
        else:
            s.update(fresh())
    return out


def taken(s: State, event: tuple[int, str, int | None, int | None], idle: int, forget: int) -> list[Step]:
    """Steps of one event, after what was due before it. s is changed."""
    at, action, rank, until = event
    out = run_due(s, at, idle, forget)
    if action == "finding":
        rank = NONE - 1 if rank is None else rank
        if s["open"] and rank < s["rank"]:
            s.update(rank=rank)
            if not s["snoozed"]:
                s.update(quiet=False)
                out.append((at, "escalated", False))
        elif not s["open"] and rank < s["accepted"]:
            first = not s["known"]
            s.update(fresh(), open=True, rank=rank, opened=at, quiet=first)
            out.append((at, "baseline" if first else "opened", first))
    elif action == "clean":
        if s["open"]:
            out.append((at, "resolved", s["quiet"]))
        _closed(s)
    elif action == "snooze" and s["open"] and until is not None and until > at:
        s.update(snoozed=until, asleep=s["rank"])
        out.append((at, "snoozed", s["quiet"]))
    elif action == "accept" and s["open"]:
        out.append((at, "accepted", s["quiet"]))
        _closed(s, accepted=s["rank"])
    if action in ("finding", "clean"):
        s.update(last=at, known=True)
    return out


class Machine(StatefulProcessor):
    """The machine on Spark's state: a value (the incident) and a list (events that the watermark has not passed)."""

    def __init__(self, keys: list[str], idle: int, forget: int) -> None:
        self.keys, self.idle, self.forget = keys, idle, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("incident", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def _held(self) -> State:
        return dict(zip(STATE.names, self.state.get())) if self.state.exists() else fresh()

    def _watch(self, s: State, waiting: list[tuple]) -> None:
        """A timer for the next thing to do."""
        due = deadline(s, self.idle, self.forget)
        nexts = [e[0] for e in waiting] + ([due[0]] if due else [])
        if nexts:
            self.handle.registerTimer(min(nexts) // 1000 + 1)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        row = initialState.iloc[0]
        s = {**fresh(), "open": True, "rank": int(row["rank"]), "opened": int(row["opened"]), "last": int(row["last"]), "known": True}
        self.state.update(tuple(s.values()))
        self._watch(s, [])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = []
        for part in rows:
            for e in part.itertuples(index=False):
                until = None if pd.isna(e.until) else int(e.until)
                came.append((int(e.at), e.action, None if pd.isna(e.rank) else int(e.rank), until))
        self.waiting.appendList(came)
        self._watch(fresh(), came)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = (timerValues.getCurrentWatermarkInMs() - 1) * 1000 + 999  # the last microsecond that is settled
        s, held = self._held(), list(self.waiting.get())
        ready = sorted((e for e in held if e[0] <= passed), key=lambda e: (e[0], e[1], e[2] if e[2] is not None else NONE, e[3] or 0))
        later = [e for e in held if e[0] > passed]
        out: list[Step] = []
        for e in ready:
            out += taken(s, e, self.idle, self.forget)
        out += run_due(s, passed, self.idle, self.forget)
        if len(later) < len(held):
            self.waiting.put(later) if later else self.waiting.clear()
        if s == fresh():
            self.state.clear()
        else:
            self.state.update(tuple(s.values()))
        self._watch(s, later)
        if out:
            names = key if isinstance(key, tuple) else (key,)
            yield pd.DataFrame({**{k: [v] * len(out) for k, v in zip(self.keys, names)}, "at": [o[0] for o in out], "step": [o[1] for o in out], "quiet": [o[2] for o in out]})

    def close(self) -> None:
        pass


def machine(events: DataFrame, keys: list[str], late: str = "1 day", idle_days: int = 30, forget_days: int = 365, opened: DataFrame | None = None) -> DataFrame:
    """keys, at (microseconds), step, quiet: what becomes of the incidents of a stream of events (keys, ts, action, rank, until).

    opened: a batch table (keys, rank, opened, last; times in microseconds) of incidents that are open at the start, one a
    key. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Events later than late are dropped by the
    watermark; unknown actions change nothing. A key's list is what has come within the watermark's delay.
    """
    kind = dict(events.dtypes)
    micros = lambda c: F.unix_micros(c)
    rows = events.withWatermark("ts", late).select(*keys, "ts", micros("ts").alias("at"), "action", F.col("rank").cast("int").alias("rank"), micros("until").alias("until"))
    out = StructType.fromDDL(", ".join(f"{k} {kind[k]}" for k in keys) + ", at long, step string, quiet boolean")
    start = opened.select(*keys, "rank", "opened", "last").groupBy(*keys) if opened is not None else None
    return rows.groupBy(*keys).transformWithStateInPandas(Machine(keys, idle_days * _DAY, forget_days * _DAY), out, "append", "EventTime", initialState=start)
