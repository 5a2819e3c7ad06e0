"""Structured Streaming forms of the time-dependent operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def tallied(stream: DataFrame, key: str, time: str = "ts", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts per key and window; a window is final once the watermark passes it."""
    w = F.window(time, width).alias("w")
    return stream.withWatermark(time, late).groupBy(key, w).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def admitted_calls(times: list[int], before: list[int], most: int, span: int) -> tuple[list[bool], list[int]]:
    """Which calls are accepted when at most `most` accepted ones may lie within span; refused calls do not count."""
    held, out = list(before), []
    for t in times:
        held = [x for x in held if x > t - span]
        out.append(len(held) < most)
        if out[-1]:
            held.append(t)
    return out, held


def _keep_until(state: GroupState, last_us: int, span_us: int) -> None:
    """Lets the state of a key end once the watermark is a span beyond its last row."""
    state.setTimeoutTimestamp(max((last_us + span_us) // 1000, state.getCurrentWatermarkMs()) + 1)


def admission(stream: DataFrame, key: str, most: int = 30, span_seconds: int = 60, time: str = "ts", id_col: str = "event_id", late: str = "1 day") -> DataFrame:
    """key, id, accepted of a stream of calls. The state of a key is its accepted calls within the span, `most` at most;
    it goes when the watermark has passed the span."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = list(state.get[0]) if state.exists else []
        calls = pd.concat(list(parts)).sort_values([time, id_col])
        at = calls[time].astype("datetime64[us]").astype("int64").tolist()
        ok, held = admitted_calls(at, before, most, span_seconds * 1_000_000)
        state.update((held,))
        _keep_until(state, max(at), span_seconds * 1_000_000)
        yield pd.DataFrame({key: k[0], id_col: calls[id_col], "accepted": ok})

    picked = stream.select(key, id_col, time).withWatermark(time, late)
    kind = dict(picked.dtypes)
    return picked.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {id_col} {kind[id_col]}, accepted boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def incident_step(held: dict | None, rows: list[tuple]) -> tuple[dict, list[tuple]]:
    """(state, findings in time order) -> (state, transitions). A finding is (time, rank or None): None is judged clean.

    An incident opens at a finding, escalates when its rank falls below the least so far, and resolves at a clean
    judgement; it can open again.
    """
    state = dict(held or {"open": False, "rank": 9, "opened": 0})
    out = []
    for t, rank in rows:
        if rank is None:
            if state["open"]:
                out.append((t, "resolved"))
            state.update(open=False, rank=9)
        elif not state["open"]:
            out.append((t, "opened"))
            state.update(open=True, rank=rank, opened=t)
        elif rank < state["rank"]:
            out.append((t, "escalated"))
            state["rank"] = rank
    return state, out


def incidents(stream: DataFrame, keys: list[str], time: str = "ts", rank: str = "rank", late: str = "1 day", idle_days: int = 30) -> DataFrame:
    """Transitions (keys, at, step) of incidents keyed by keys, from a stream of judgements (time, rank or null).

    The state of a closed incident goes at once; that of an open one stays until it is resolved, or until nothing was
    judged for idle_days, when it ends as lapsed.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at = state.get[2]
            state.remove()
            yield pd.DataFrame({**{c: [v] for c, v in zip(keys, k)}, "at": [at + idle_days * 86_400_000_000], "step": ["lapsed"]})
            return
        held = dict(zip(("open", "rank", "opened"), state.get)) if state.exists else None
        rows = pd.concat(list(parts)).sort_values(time)
        at = rows[time].astype("datetime64[us]").astype("int64")
        judged = [(int(t), None if pd.isna(r) else int(r)) for t, r in zip(at, rows[rank])]
        held, out = incident_step(held, judged)
        if held["open"]:
            # What is kept as the time of the incident is that of its last judgement.
            last = max(t for t, _ in judged)
            state.update((True, held["rank"], last))
            _keep_until(state, last, idle_days * 86_400_000_000)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({**{c: [v] * len(out) for c, v in zip(keys, k)}, "at": [t for t, _ in out], "step": [s for _, s in out]})

    kind = dict(stream.dtypes)
    out = ", ".join(f"{c} {kind[c]}" for c in keys) + ", at long, step string"
    rows = stream.select(*keys, time, rank).withWatermark(time, late)
    return rows.groupBy(*keys).applyInPandasWithState(step, out, "open boolean, rank long, opened long", "append", GroupStateTimeout.EventTimeTimeout)


def live_tally(stream: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """name, n over a stream of pages: pages, with_issues, and each check that pages fail, as they come in."""
    held = F.array_compact(F.array(*(F.when(holds, F.lit(slug)) for slug, holds in flags.items())))
    names = F.concat(F.array(F.lit("pages")), F.when(F.size(held) > 0, F.array(F.lit("with_issues"))).otherwise(F.array().cast("array<string>")), held)
    return stream.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
