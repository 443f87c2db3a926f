"""The request history: rows that never hold a query's text, appended once for each batch."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def history_rows(log: DataFrame) -> DataFrame:
    """log(ts, endpoint, query, status, duration_s, ...) as history rows; of the query its SHA-256 and length stay.

    model, cached, trace_id, error and metadata (a struct or map, kept as JSON) are null, false or `{}` where the log lacks them.
    """
    query = F.coalesce("query", F.lit(""))
    has = lambda name, other: F.col(name) if name in log.columns else F.lit(other)
    metadata = F.coalesce(F.to_json("metadata"), F.lit("{}")) if "metadata" in log.columns else F.lit("{}")
    return log.select(
        F.col("ts").alias("created_at"),
        F.col("endpoint").alias("route"),
        F.sha2(query, 256).alias("query_hash"),
        F.length(query).alias("query_length"),
        has("model", None).cast("string").alias("model"),
        (F.col("status") < 500).alias("success"),
        F.coalesce(has("cached", False), F.lit(False)).alias("cached"),
        F.round(F.col("duration_s") * 1000, 3).alias("response_ms"),
        has("trace_id", None).cast("string").alias("trace_id"),
        has("error", None).cast("string").alias("error"),
        metadata.alias("metadata"),
    )


def append_history(rows: DataFrame, path: str, batch: int | str | None = None) -> None:
    """Add rows to the table at path, by day, as one batch. The same batch again replaces what it wrote before, so a
    failed or repeated run leaves each row once; without a number a call is a batch of its own."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch={uuid.uuid4().hex if batch is None else batch}")


def stream_history(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """History rows of a streaming log, appended batch by batch until it has no more; micro-batches keep their number when they are run again."""
    rows = history_rows(log)
    return rows.writeStream.foreachBatch(lambda df, batch: append_history(df, path, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def history_snapshot(history: DataFrame) -> DataFrame:
    """Records, successes and cache hits of each route and model."""
    n = lambda name: F.sum(F.col(name).cast("long"))
    return history.groupBy("route", "model").agg(F.count("*").alias("n"), n("success").alias("n_success"), n("cached").alias("n_cached"))


def write_results_jsonl(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
