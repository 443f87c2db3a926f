"""Replays of rate limits, caches and circuit breakers over a request log.

Each is a small state machine that sees one request after the other. A key's state is forgotten once nothing has
happened to it for longer than the window (or lifetime), so its events fall into islands at such gaps; a breaker's
islands start where it is surely closed. Islands are dealt to tasks, sorted by time and event_id, and replayed one after
the other over Arrow batches; a task holds one state at a time.
"""

from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.functions.joins import matched


class Limiter:
    """A request passes while fewer than `limit` passed in the last `window` seconds: admitted, remaining, retry_after."""

    FIELDS = "admitted boolean, remaining int, retry_after int"
    STATE = "passed array<double>"

    def __init__(self, limit: int, window: float, passed=()):
        self.limit, self.window, self.passed = limit, window, deque(passed)

    def __call__(self, at: float, ok: bool) -> tuple:
        while self.passed and at - self.passed[0] >= self.window:
            self.passed.popleft()
        if len(self.passed) >= self.limit:
            return False, 0, max(1, int(self.window - (at - self.passed[0])))
        self.passed.append(at)
        return True, self.limit - len(self.passed), 0

    def state(self) -> tuple:
        return (list(self.passed),)


class Cache:
    """A request hits if its key was set less than `ttl` seconds ago; a miss sets it, a hit doesn't extend it: hit."""

    FIELDS = "hit boolean"
    STATE = "until double"

    def __init__(self, ttl: float, until: float = float("-inf")):
        self.ttl, self.until = ttl, until

    def __call__(self, at: float, ok: bool) -> tuple:
        hit = at < self.until
        self.until = self.until if hit else at + self.ttl
        return (hit,)

    def state(self) -> tuple:
        return (self.until,)


class Breaker:
    """`threshold` failures in a row open it for `recovery` seconds, then it is closed at count 0: state (closed or rejected)."""

    FIELDS = "state string"
    STATE = "failed int, opened double"

    def __init__(self, threshold: int, recovery: float, failed: int = 0, opened: float | None = None):
        self.threshold, self.recovery, self.failed, self.opened = threshold, recovery, failed, opened

    def __call__(self, at: float, ok: bool) -> tuple:
        if self.opened is not None and at - self.opened >= self.recovery:
            self.failed, self.opened = 0, None
        if self.opened is not None:
            return ("rejected",)
        self.failed = 0 if ok else self.failed + 1
        if self.failed >= self.threshold:
            self.opened = at
        return ("closed",)

    def state(self) -> tuple:
        return self.failed, self.opened


def replayed(rows: DataFrame, keys: list[str], begin: Callable, fields: str) -> DataFrame:
    """event_id and the fields that begin()'s machine gives for rows(keys, event_id, at, ok), a new one for each value of the keys."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"event_id long, {fields}"
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        key, machine = None, None
        for batch in batches:
            columns = batch.to_pydict()
            out = []
            for *own, event, at, ok in zip(*(columns[c] for c in (*keys, "event_id", "at", "ok")), strict=True):
                if own != key:
                    key, machine = own, begin()
                out.append((event, *machine(at, ok)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), shape.types, strict=True)], schema=shape)

    dealt = rows.select(*keys, "event_id", "at", "ok").repartition(*keys).sortWithinPartitions(*keys, "at", "event_id")
    return dealt.mapInArrow(run, schema)


def timed(log: DataFrame) -> DataFrame:
    """log(ts, status) with at (epoch seconds) and ok (no server error)."""
    return log.withColumn("at", F.unix_micros("ts") / 1e6).withColumn(
        "ok", F.coalesce(F.col("status") < 500, F.lit(True)) if "status" in log.columns else F.lit(True)
    )


def with_islands(log: DataFrame, gap: float, *keys: str, spans: int = 16) -> DataFrame:
    """log with at, ok and the island (island_span, island) of each event: a key's events with less than `gap` seconds between them.

    Events are put in order in spans of `spans` gaps; only one row a span is put in order over a key. What comes before a
    span's first gap goes on with the last island of an earlier span, if that is near enough.
    """
    rows = timed(log).withColumn("span", F.floor(F.col("at") / (spans * gap)))
    order = W.partitionBy(*keys, "span").orderBy("at", "event_id")
    cut = F.coalesce((F.col("at") - F.lag("at").over(order) >= gap).cast("int"), F.lit(0))
    rows = rows.withColumn("cut", cut).withColumn("n", F.sum("cut").over(order))
    each = rows.groupBy(*keys, "span").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max("n").alias("cuts"))
    over = W.partitionBy(*keys).orderBy("span")
    each = each.withColumn("opens", F.coalesce(F.col("first") - F.lag("last").over(over) >= gap, F.lit(True)))
    here = F.struct("span", "cuts")
    last = F.last(F.when((F.col("cuts") > 0) | F.col("opens"), here), ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, -1))
    own = F.struct("span", F.lit(0).cast("long").alias("cuts"))
    each = each.select(*keys, "span", F.when(F.col("opens"), own).otherwise(last).alias("head"))
    rows = matched(rows, each, [*keys, "span"])  # requests without a key are a key of their own
    inner = F.col("n") > 0
    islands = {"island_span": F.when(inner, F.col("span")).otherwise(F.col("head.span")), "island": F.when(inner, F.col("n")).otherwise(F.col("head.cuts"))}
    return rows.withColumns(islands).drop("span", "cut", "n", "head")


def rate_limit(log: DataFrame, limit: int, window: float) -> DataFrame:
    """event_id, admitted, remaining and retry_after for each endpoint and subject."""
    rows = with_islands(log, window, "endpoint", "subject")
    return replayed(rows, ["endpoint", "subject", "island_span", "island"], lambda: Limiter(limit, window), Limiter.FIELDS)


def ttl_cache(log: DataFrame, ttl: float) -> DataFrame:
    """event_id and hit for each endpoint and subject."""
    rows = with_islands(log, ttl, "endpoint", "subject")
    return replayed(rows, ["endpoint", "subject", "island_span", "island"], lambda: Cache(ttl), Cache.FIELDS)


def breaker_islands(rows: DataFrame, threshold: int, recovery: float) -> DataFrame:
    """rows (endpoint, event_id, at, ok) with their island (island_span, island).

    A breaker opens only at the last of `threshold` failures in a row, so a success with no such event in the `recovery`
    seconds up to it leaves it closed at count 0. This is told in spans of time of their own; what lies before a span
    counts as failures, which only makes islands longer. Only one row a span is put in order over an upstream.
    """
    rows = rows.withColumn("span", F.floor(F.col("at") / (4 * recovery)))
    order = W.partitionBy("endpoint", "span").orderBy("at", "event_id")
    opens = ~F.col("ok")
    for k in range(1, threshold):
        opens &= ~F.coalesce(F.lag("ok", k).over(order), F.lit(False))
    rows = rows.withColumn("opens", F.when(opens, F.col("at")))
    last = F.coalesce(F.max("opens").over(order.rowsBetween(W.unboundedPreceding, 0)), F.col("span") * (4 * recovery))
    rows = rows.withColumn("sure", (F.col("ok") & (F.col("at") - last >= recovery)).cast("int"))
    rows = rows.withColumn("island", F.coalesce(F.sum("sure").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # events before a span's first cut go on with the last island of an earlier span
    spans = rows.groupBy("endpoint", "span").agg(F.sum("sure").alias("cuts"))
    before = W.partitionBy("endpoint").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    cut = F.when(F.col("cuts") > 0, F.struct("span", "cuts"))
    spans = spans.select("endpoint", "span", F.last(cut, ignorenulls=True).over(before).alias("from"))
    rows = matched(rows, spans, ["endpoint", "span"])
    own = F.col("island") > 0
    island = F.when(own, F.col("island")).otherwise(F.coalesce("from.cuts", F.lit(0)))
    return rows.select(
        "endpoint", "event_id", "at", "ok", F.when(own, F.col("span")).otherwise(F.col("from.span")).alias("island_span"), island.alias("island")
    )


def circuit_breaker(log: DataFrame, threshold: int, recovery: float) -> DataFrame:
    """event_id and state for each upstream (endpoint); islands start behind events that surely leave it closed at count 0."""
    rows = timed(log).select("endpoint", "event_id", "at", "ok")
    return replayed(
        breaker_islands(rows, threshold, recovery), ["endpoint", "island_span", "island"], lambda: Breaker(threshold, recovery), Breaker.FIELDS
    )
