"""Replays, batch and streaming, against one straight pass; monitors against brute force."""

import datetime as dt
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagesift.operators import monitor, replay
from pagesift.streaming import replay as streams

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events():
    """A hot key, others, ties of time, pauses, failures."""
    draw, at, out = random.Random(7), 0.0, []
    for e in range(3000):
        at += draw.choice([0, 0, 1, 3, 7, 7, 90])
        out.append((e, at, "api" if draw.random() < 0.6 else draw.choice("abc"), draw.choice([1, 1, 1, 2, 3]), 500 if draw.random() < 0.3 else 200))
    return out


@pytest.fixture(scope="module")
def log(spark, events):
    rows = [(e, BASE + dt.timedelta(seconds=t), k, s, c) for e, t, k, s, c in events]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, endpoint string, subject int, status int").repartition(5)


def straight(events, begin, by_subject=True):
    machines, out = {}, {}
    for e, t, k, s, c in sorted(events, key=lambda x: (x[1], x[0])):
        machine = machines.setdefault((k, s) if by_subject else k, begin())
        out[e] = machine(t, c < 500)
    return out


CASES = [
    ("rate_limit", (2, 20.0), lambda: replay.Limiter(2, 20.0), True),
    ("ttl_cache", (15.0,), lambda: replay.Cache(15.0), True),
    ("circuit_breaker", (2, 30.0), lambda: replay.Breaker(2, 30.0), False),
]


@pytest.mark.parametrize(("name", "settings", "begin", "by_subject"), CASES)
def test_batch(log, events, name, settings, begin, by_subject):
    got = {r[0]: tuple(r)[1:] for r in getattr(replay, name)(log, *settings).collect()}
    assert got == straight(events, begin, by_subject)


@pytest.mark.parametrize(("name", "settings", "begin", "by_subject"), CASES)
def test_streams(spark, log, events, tmp_path, name, settings, begin, by_subject):
    """Two files that arrive one after the other give what the whole log gives."""
    middle = BASE + dt.timedelta(seconds=events[1500][1])
    log.where(F.col("ts") <= F.lit(middle)).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    later = log.where(F.col("ts") > F.lit(middle)).coalesce(1)
    stream = getattr(streams, name)(
        spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), *settings
    )
    for k in range(2):
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")
        ).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        if not k:
            later.write.parquet(str(tmp_path / "in" / "b"))
    got = {r[0]: tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == straight(events, begin, by_subject)


@pytest.mark.parametrize("spans", [1, 2, 16])
def test_islands(log, events, spans):
    """Two events of a key are in one island just if no pause of 20 seconds lies between them."""
    got = {r.event_id: (r.endpoint, r.subject, r.island_span, r.island) for r in replay.with_islands(log, 20.0, "endpoint", "subject", spans=spans).collect()}
    last, want, n = {}, {}, 0
    for e, t, k, s, _ in sorted(events, key=lambda x: (x[1], x[0])):
        if (k, s) not in last or t - last[k, s][0] >= 20:
            n += 1
            last[k, s] = (t, n)
        last[k, s] = (t, last[k, s][1])
        want[e] = last[k, s][1]
    assert len(set(zip(got.values(), (want[e] for e in got), strict=True))) == len(set(want.values())) == len(set(got.values()))


def test_limiter_by_hand():
    one = replay.Limiter(1, 60.0)
    assert [one(0.0, True), one(59.5, True), one(60.0, True)] == [(True, 0, 0), (False, 0, 1), (True, 0, 0)]


def test_cache_by_hand():
    one = replay.Cache(10.0)
    assert [one(t, True)[0] for t in (0.0, 5.0, 9.9, 10.0, 12.0)] == [False, True, True, False, True]


def test_breaker_by_hand():
    one = replay.Breaker(2, 30.0)
    seen = [one(t, ok)[0] for t, ok in ((0.0, False), (1.0, False), (2.0, True), (30.9, True), (31.0, False), (32.0, True), (33.0, False))]
    assert seen == ["closed", "closed", "rejected", "rejected", "closed", "closed", "closed"]


def test_in_flight_and_latency(spark):
    draw = random.Random(3)
    rows = [(draw.choice("ab"), draw.randrange(0, 20_000), draw.choice([0.5, 1.0, 1.0, 60.0, 7200.0])) for _ in range(400)] + [("c", 5, 2.0)]
    log = spark.createDataFrame([(k, BASE + dt.timedelta(seconds=t), d) for k, t, d in rows], "endpoint string, ts timestamp, duration_s double")
    most, by = {}, defaultdict(list)
    for k in "abc":
        changes = sorted([(t, 1) for x, t, d in rows if x == k] + [(t + d, -1) for x, t, d in rows if x == k])
        now = top = 0
        for _, d in changes:
            now += d
            top = max(top, now)
        most[k] = top
    assert {r.endpoint: r.most for r in monitor.in_flight(log, "endpoint").collect()} == most
    for k, _, d in rows:
        by[k].append(d)
    for r in monitor.latency_stats(log, "endpoint").collect():
        x = by[r.endpoint]
        assert r.n == len(x) and abs(r.mean - statistics.fmean(x)) < 1e-5 and abs(r["median"] - statistics.median(x)) < 1e-6
        if len(x) > 1:
            assert abs(r.p95 - statistics.quantiles(x, n=20)[18]) < 1e-6


def test_error_spells_over_midnight(spark):
    """A spell from 23:50 to past the next midnight, one of two whole days, and one too short."""
    spans = [(86_400 - 600, 86_400 + 900), (3 * 86_400 - 30, 5 * 86_400 + 60), (7 * 86_400, 7 * 86_400 + 60)]
    rows = [(t, 500) for a, b in spans for t in range(a, b, 15)]
    log = spark.createDataFrame(rows, "s long, status int").select(F.timestamp_seconds("s").alias("ts"), "status")
    got = sorted(map(tuple, monitor.error_rate_alert(log).collect()))
    assert got == [(86_400 - 585, 86_400 + 885 + 300), (3 * 86_400 - 15, 5 * 86_400 + 45 + 300), (7 * 86_400 + 15, 7 * 86_400 + 345)]
    assert [x for x in map(tuple, monitor.error_rate_alert(log, hold=400).collect())].__len__() == 2


def test_requests_without_a_key(spark):
    """Anonymous requests and those of no known endpoint are keys of their own; no row is lost."""
    rows = [(k, BASE + dt.timedelta(seconds=k % 40), ("a", None, "b")[k % 3], (None, 7)[k % 2], 200 if k % 5 else 500, 1.0) for k in range(60)]
    log = spark.createDataFrame(rows, "event_id long, ts timestamp, endpoint string, subject long, status int, duration_s double")
    named = log.fillna({"endpoint": "none", "subject": -1})
    for run in (lambda x: replay.rate_limit(x, 2, 30.0), lambda x: replay.ttl_cache(x, 5.0), lambda x: replay.circuit_breaker(x, 2, 4.0)):
        got = sorted(map(tuple, run(log).collect()))
        assert len(got) == 60 and got == sorted(map(tuple, run(named).collect()))
    for run in (lambda x: monitor.in_flight(x, "endpoint"), lambda x: monitor.in_flight_changes(x, "endpoint"), lambda x: monitor.in_flight_series(x, "endpoint"), lambda x: monitor.latency_stats(x, "endpoint")):
        got = run(log).fillna({"endpoint": "none"}).collect()
        assert {r.endpoint for r in got} == {"a", "b", "none"} and sorted(map(str, got)) == sorted(map(str, run(named).collect()))


def test_in_flight_series_by_hand(spark):
    log = spark.createDataFrame([(BASE, 20.0), (BASE + dt.timedelta(seconds=10), 50.0), (BASE + dt.timedelta(seconds=600), 3.0)], "ts timestamp, duration_s double").withColumn("endpoint", F.lit("a"))
    at = int(BASE.replace(tzinfo=dt.timezone.utc).timestamp())
    start = at - at % 15
    got = [(r["at"] - start, r.in_flight, r["mean"]) for r in monitor.in_flight_series(log, "endpoint").orderBy("at").collect()]
    assert at == start and got == [(15, 2, round(20 / 15, 6)), (30, 1, round(20 / 15, 6)), (45, 1, 1.0), (60, 1, 1.0), (615, 0, 0.2)]
