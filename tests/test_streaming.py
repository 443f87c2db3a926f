"""Streams of arriving files end with the rows of the same batch."""

from pyspark.sql import functions as F

from pagesift.operators import monitor as batch
from pagesift.streaming import monitor


def run(spark, df, mode, folder):
    query = df.writeStream.format("memory").queryName(f"out_{mode}").outputMode(mode).option(
        "checkpointLocation", str(folder / "state")
    ).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    return spark.table(f"out_{mode}")


def test_progress(spark, tmp_path):
    rows = [(1, "abc", None), (1, None, "timeout"), (2, "de", None)]
    spark.createDataFrame(rows, "query_id long, content string, error string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, content string, error string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = run(spark, monitor.progress(stream), "complete", tmp_path)
    assert sorted(map(tuple, last.collect())) == [(1, 2, 1, 3), (2, 1, 1, 2)]


def test_windowed_counts(spark, tmp_path):
    log = spark.createDataFrame(
        [(0, 200), (30, 200), (61, 500), (9000, 200)], "s long, status int"
    ).select(F.timestamp_seconds("s").alias("ts"), "status")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, status int").parquet(str(tmp_path / "in"))
    closed = run(spark, monitor.windowed_counts(stream, "status", 300, 60), "append", tmp_path)
    want = batch.windowed_counts(log, "status", 300, 60).where("window_end <= 7200")
    shown = lambda df: sorted((r.window_end, r.status, r.n) for r in df.collect())
    assert shown(closed) == shown(want) and closed.count()


def test_state_of_finished_and_idle_queries_goes(spark, tmp_path):
    """Rows of state are those of queries under way: finished ones leave at once, idle ones once the watermark has passed them."""
    import datetime as dt

    base, schema = dt.datetime(2024, 1, 1), "query_id long, ts timestamp, error string, content string, target int"
    steps = [
        [(1, 0, None, "abc", 2), (2, 1, None, "x", 3), (3, 1, "timeout", None, 1)],
        [(1, 5, "timeout", None, 2), (4, 5, None, "later", 9)],
        [(5, 400, None, "far", 9)],
        [(6, 401, None, "farther", 9)],
        [(7, 402, None, "farther", 9)],
    ]
    (tmp_path / "in").mkdir()
    arriving = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query, seen = None, []
    for k, step in enumerate(steps):
        rows = [(q, base + dt.timedelta(minutes=m), e, c, t) for q, m, e, c, t in step]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = monitor.expiring_progress(arriving).writeStream.foreachBatch(lambda df, i: seen.extend(map(tuple, df.collect()))).outputMode("update")
        query = query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        if k == 1:
            assert left[-1] == 2  # queries 2 and 4
    assert left[-1] == 3  # 5, 6 and 7: those before have timed out
    assert (1, 2, 1, 3, True) in seen and (3, 1, 0, 0, True) in seen and (2, 1, 1, 1, False) in seen
