"""Streaming forms: windowed counts of a request log, and progress of queries from finished sources."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(log: DataFrame, by: str, width: int = 300, slide: int = 15, late: str = "10 minutes") -> DataFrame:
    """window_end (epoch seconds), `by` and n, as the batch form gives them; rows later than the watermark are left out (append mode).

    Two stateful steps in a chain: rows are counted in buckets of one slide, and closed buckets are added up to their
    windows. A row is counted once; only the few buckets are copied to the windows that hold them.
    """
    buckets = log.withWatermark("ts", late).groupBy(F.window("ts", f"{slide} seconds").alias("bucket"), by).agg(F.count("*").alias("m"))
    at = F.window_time("bucket")
    windows = buckets.groupBy(F.window(at, f"{width} seconds", f"{slide} seconds").alias("w"), by).agg(F.sum("m").alias("n"))
    return windows.select(F.unix_seconds("w.end").alias("window_end"), by, "n")


def progress(results: DataFrame) -> DataFrame:
    """Of each query so far: sources done, without error, and characters gathered (for update mode)."""
    good = F.col("error").isNull()
    return results.groupBy("query_id").agg(
        F.count("*").alias("done"), F.sum(good.cast("long")).alias("succeeded"),
        F.sum(F.when(good, F.length("content")).otherwise(0)).alias("total_chars")
    )


def expiring_progress(results: DataFrame, target: str = "target", idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Progress of a stream results(query_id, ts, error, content, target): done, succeeded, total_chars, finished (update mode).

    A query's state goes when all of its sources are done, or once the watermark is `idle` beyond its last one, so state
    holds the queries under way and no others. Sources that come later still begin a new count.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    schema = "query_id long, done long, succeeded long, total_chars long, finished boolean"

    def run(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        done, good, chars = state.get if state.exists else (0, 0, 0)
        last, wanted = 0, None
        for rows in batches:
            done, good, chars = done + len(rows), good + int(rows["ok"].sum()), chars + int(rows["n"].sum())
            last = max(last, int(rows["ms"].max()))
            if rows["wanted"].notna().any():
                wanted = int(rows["wanted"].max())
        finished = wanted is not None and done >= wanted
        if finished and state.exists:
            state.remove()
        elif not finished:
            state.update((done, good, chars))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame([(key[0], done, good, chars, finished)], columns=["query_id", "done", "succeeded", "total_chars", "finished"])

    ok = F.col("error").isNull()
    rows = results.withWatermark("ts", late).select(
        "query_id", "ts", ok.alias("ok"), F.when(ok, F.coalesce(F.length("content"), F.lit(0))).otherwise(0).alias("n"), F.unix_millis("ts").alias("ms"),
        F.col(target).cast("double").alias("wanted")
    )
    return rows.groupBy("query_id").applyInPandasWithState(run, schema, "done long, succeeded long, total_chars long", "update", GroupStateTimeout.EventTimeTimeout)
