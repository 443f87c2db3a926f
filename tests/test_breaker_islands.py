"""A breaker's islands give the states of one replay over all events, and no island holds the whole log."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pagesift.operators import replay


def replayed(events, threshold, recovery):
    failed, opened, out = 0, None, {}
    for t, e, ok in sorted(events):
        if opened is not None and t - opened >= recovery:
            failed, opened = 0, None
        out[e] = "closed" if opened is None else "rejected"
        if opened is None:
            failed = 0 if ok else failed + 1
            if failed >= threshold:
                opened = t
    return out


def test_breaker_islands(spark):
    draw = random.Random(3)
    at, rows = 0, []
    for e in range(4000):
        at += draw.choice([0, 1, 5, 20, 20, 40])
        rows.append(("all", e, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at), 500 if draw.random() < 0.25 else 200))
    base = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame(rows, "endpoint string, event_id long, ts timestamp, status int")
    for threshold, recovery in ((2, 60.0), (3, 100.0), (1, 30.0)):
        got = {r.event_id: r.state for r in replay.circuit_breaker(log, threshold, recovery).collect()}
        assert got == replayed([((r[2] - base).total_seconds(), r[1], r[3] < 500) for r in rows], threshold, recovery)
    small = log.select("endpoint", "event_id", (F.unix_micros("ts") / 1e6).alias("at"), (F.col("status") < 500).alias("ok"))
    sizes = [r["count"] for r in replay.breaker_islands(small, 3, 100.0).groupBy("endpoint", "island_span", "island").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 400
