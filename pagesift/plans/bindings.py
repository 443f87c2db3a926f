"""Tables of the operators, drawn from the given tables."""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions import urls as U


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder of the cluster; where none is set, beside the warehouse of a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if root.startswith(("file:", "/")) and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/pagesift-{uuid.uuid4().hex}"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and query, each benchmark item as a whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _with_query(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    n = asked.agg(F.count("*").alias("n_queries"))
    return rows.crossJoin(F.broadcast(n)).withColumn("query_id", F.col(key) % F.col("n_queries")).drop("n_queries")  # one row


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a candidate of one query, and every fourth once more by another provider under a twin URL."""
    asked = queries(spark, sf_dir)
    rows = _with_query(table(spark, sf_dir, "pages"), asked, "page_id")
    provider = lambda n: F.element_at(F.array(F.lit("duckduckgo"), F.lit("google"), F.lit("wikipedia")), (n % 3 + 1).cast("int"))
    source = F.struct(provider(F.col("page_id")).alias("provider"), F.lit(0).alias("set_pos"), F.col("url").alias("url"))
    twin = F.struct(provider(F.col("page_id") + 1).alias("provider"), F.lit(1).alias("set_pos"), F.concat("url", F.lit("#x")).alias("url"))
    rows = rows.select(
        "query_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", "<p>([^<]*)<", 1).alias("snippet"),
        F.lit("").alias("publication_date"),
        F.col("page_id").alias("pos"),
        F.inline(F.when(F.col("page_id") % 4 == 0, F.array(source, twin)).otherwise(F.array(source))),
    )
    return rows.withColumn("source", F.regexp_extract(U.host(F.col("url")), r"^([^.]*)", 1)).join(asked.withColumnRenamed("query", "search_query"), "query_id")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a scraped result of one query; every 13th failed."""
    rows = _with_query(table(spark, sf_dir, "documents"), queries(spark, sf_dir), "doc_id")
    return rows.select(
        "query_id",
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("source"),
        F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("doc_id") % 2 == 0, "2024-05-04").alias("publication_date"),
        F.col("text").alias("content"),
        F.when(F.col("doc_id") % 13 == 0, "timeout").alias("error"),
        (F.col("doc_id") % 5 + 1).alias("source_tier"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log; every 50th comes from an endpoint without a name, every 60th from no known subject."""
    endpoint = F.when(F.col("event_id") % 50 != 7, F.col("event_type"))
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 60 != 8, F.col("user_id")).alias("subject"),
        endpoint.alias("endpoint"),
        F.when(failed, 500).otherwise(200).alias("status"),
        (F.col("value") / 100).alias("duration_s"),
        (F.col("event_id") % 3 == 0).alias("cached"),
        F.when(failed, F.concat(F.lit("upstream "), (F.col("user_id") % 7).cast("string"), F.lit(" failed"))).alias("error"),
    )


def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as history, appended in two batches, of which the second is appended twice, and read again."""
    from pagesift.sources import history

    rows, path = history.history_rows(asked_log(spark, sf_dir)), scratch(spark)
    for batch, part in ((0, "query_length % 2 = 0"), (1, "query_length % 2 = 1"), (1, "query_length % 2 = 1")):
        history.append_history(rows.where(part), path, batch)
    return history.read_history(spark, path)


def asked_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with queries, models, traces and metadata."""
    subject = F.coalesce(F.col("subject").cast("string"), F.lit(""))
    return log(spark, sf_dir).withColumns({
        "query": F.concat(F.lit("q"), subject), "model": F.concat(F.lit("model-"), (F.col("event_id") % 3).cast("string")),
        "trace_id": F.concat(F.lit("t-"), F.col("event_id").cast("string")), "metadata": F.struct("subject", F.col("event_id").alias("event")),
    })


def reports(numbered: DataFrame) -> DataFrame:
    """A report for each query from its numbered sources, with a citation at the end of each sentence that may be off by one.

    A query has no more sources than number_citations was asked for, so that a report is bounded.
    """
    mark = F.concat(F.lit(" ["), (F.col("n") + F.col("pos") % 2).cast("string"), F.lit("]. "))
    part = F.concat(F.regexp_replace("content", F.lit(r"\.\s+"), mark), mark)
    return numbered.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))), lambda x: x["p"]), "").alias("text")
    )
