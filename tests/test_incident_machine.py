"""The incident machine: cases by hand, and the stream against a plain fold however it is cut."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pagewright.streaming import incidents as I

DAY = 86_400_000_000
IDLE, FORGET = 10 * DAY, 40 * DAY
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(events, to, start=None):
    s, out = dict(start or I.fresh()), []
    for e in sorted(events, key=lambda e: (e[0], e[1], e[2] if e[2] is not None else I.NONE, e[3] or 0)):
        if e[0] <= to:
            out += I.taken(s, e, IDLE, FORGET)
    return out + I.run_due(s, to, IDLE, FORGET), s


def steps(*events, to=1000):
    return [(t / DAY, what, quiet) for t, what, quiet in fold([(int(d * DAY), a, r, u and int(u * DAY)) for d, a, r, u in events], to * DAY)[0]]


def test_steps_by_hand():
    clean, find = lambda d: (d, "clean", None, None), lambda d, r: (d, "finding", r, None)
    assert steps(find(1, 2), clean(2), find(3, 1), find(4, 1), find(5, 0), to=6) == [(1, "baseline", True), (2, "resolved", True), (3, "opened", False), (5, "escalated", False)]
    snoozed = [clean(1), find(2, 2), (3, "snooze", None, 6)]
    assert steps(*snoozed, find(4, 1), to=7)[1:] == [(3, "snoozed", False), (6, "escalated", False)]
    assert steps(*snoozed, find(7, 2), to=8)[2:] == [(6, "woke", False)]
    assert steps(*snoozed, clean(5), to=9)[2:] == [(5, "resolved", False)]
    assert steps(clean(1), find(2, 1), (3, "accept", None, None), find(4, 1), find(5, 0), to=6)[1:] == [(3, "accepted", False), (5, "opened", False)]
    assert steps(clean(1), find(2, 1), (3, "accept", None, None), clean(4), find(5, 1), to=6)[2:] == [(5, "opened", False)]
    assert steps(clean(1), find(2, 1), to=12) == [(2, "opened", False), (12, "lapsed", False)]
    assert steps(find(1, 1), to=100)[-1] == (11, "lapsed", True) and fold([(DAY, "clean", None, None)], 100 * DAY)[1] == I.fresh()
    assert steps((1, "snooze", None, 5), (2, "accept", None, None), (3, "other", None, None)) == []


def made(seed, n=160):
    """Events of five keys, each at most half a day before its place in the stream's order."""
    rng, out, t = random.Random(seed), [], 0
    for _ in range(n):
        t += int(rng.random() * DAY)
        at = t - int(rng.random() * DAY / 2)
        action = rng.choice(["finding"] * 6 + ["clean", "clean", "snooze", "accept"])
        out.append((rng.randrange(5), at + 20 * 365 * DAY, action, rng.randrange(4) if action == "finding" else None, at + 20 * 365 * DAY + int(rng.random() * 6 * DAY) if action == "snooze" else None))
    return out


@pytest.mark.parametrize("cuts", [1, 7])
def test_stream_is_the_fold_however_it_is_cut(spark, tmp_path, cuts):
    events = made(3)
    start = {0: {**I.fresh(), "open": True, "rank": 2, "opened": events[0][1] - 9 * DAY, "last": events[0][1] - 9 * DAY, "known": True}}
    stamp = lambda us: None if us is None else dt.datetime.fromtimestamp(us / 1e6, dt.timezone.utc)
    rows = [(k, stamp(at), a, r, stamp(u)) for k, at, a, r, u in events]
    ddl = "key long, ts timestamp, action string, rank int, until timestamp"
    edges = sorted({0, len(rows), *random.Random(cuts).sample(range(1, len(rows)), cuts - 1)})
    for n, (a, z) in enumerate(zip(edges, edges[1:])):
        spark.createDataFrame(rows[a:z], ddl).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03}")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
        opened = spark.createDataFrame([(k, s["rank"], s["opened"], s["last"]) for k, s in start.items()], "key long, rank int, opened long, last long")
        out = I.machine(stream, ["key"], "1 day", 10, 40, opened)
        run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    settled = (max(e[1] for e in events) // 1000 - DAY // 1000 - 1) * 1000 + 999  # the watermark is the last time less a day
    want = sorted((k, *step) for k in range(5) for step in fold([e[1:] for e in events if e[0] == k], settled, start.get(k))[0])
    assert got == want and {s for _, _, s, _ in got} >= {"opened", "escalated", "resolved", "snoozed", "accepted"}
