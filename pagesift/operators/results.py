"""Scraped results: relevance, order of citation, and packing for a model."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift import constants as K
from pagesift.functions import text as T
from pagesift.functions.joins import matched
from pagesift.functions.numbers import half_even
from pagesift.functions.urls import bound

NOTE = K.CONTENT_NOTE
RULE = "\n\n---\n\n"


def filter_low_quality(results: DataFrame, least: int = 100) -> DataFrame:
    return results.where("error is null and content is not null").where(F.length(F.trim("content")) >= least)


def cap_content(results: DataFrame, size: int = 10_000) -> DataFrame:
    return results.withColumn(
        "content", F.when(F.length("content") > size, F.concat(F.substring("content", 1, size), F.lit(NOTE))).otherwise(F.col("content"))
    )


def thin_pages(results: DataFrame, least: int = 250) -> DataFrame:
    return results.where(F.length(F.trim(F.coalesce("content", F.lit("")))) < least)


def with_relevance(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Share of the query's telling words that the content holds, to two digits."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("query"), r"[^\w\s]", " "), r"\s+"), lambda w: w != ""))
    stop = F.array(*map(F.lit, K.RELEVANCE_STOPWORDS))
    long = F.filter("words", lambda w: (F.length(w) > 3) & ~F.array_contains(stop, T.folded(w)))
    middle = F.filter("words", lambda w: F.length(w) > 2)
    telling = F.when(F.size(long) > 0, long).when(F.size(middle) > 0, middle).otherwise(F.col("words"))
    asked = queries.select("query_id", words.alias("words")).select("query_id", telling.alias("telling"))
    rows = results.join(asked, "query_id", "left")
    lower = F.lower(F.coalesce("content", F.lit("")))
    hits = bound(lower, lambda text: F.size(F.filter("telling", lambda w: text.contains(w))))  # lowered once, not for each word
    return rows.withColumn("relevance_score", F.when(F.size("telling") > 0, half_even(hits / F.size("telling"), 2)).otherwise(0.0)).drop("telling")


def number_citations(results: DataFrame) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("source_tier", F.desc("relevance_score"), "pos")
    return results.withColumn("n", F.row_number().over(order))


def context_pack(numbered: DataFrame, size: int = 2500, most: int | None = 15) -> DataFrame:
    """Of each query: its first `most` numbered sources (None: all) in order, contents cut at `size` characters, an index of them, and their whole length.

    chars, where it is there, is the length of contents that were cut before. The limit stands on the rank that
    number_citations gives, so Spark applies it to each partition before rows are shuffled: no query's whole list meets.
    Without a limit a query's blocks meet in one row.
    """
    if most is not None:
        numbered = numbered.where(F.col("n") <= most)
    n, date = F.col("n").cast("string"), F.col("publication_date")
    share = F.concat(half_even(F.col("relevance_score") * 100, 0).cast("int").cast("string"), F.lit("%"))
    block = F.concat(
        F.lit("SOURCE ["), n, F.lit("]: "), F.coalesce("source", F.lit("")), F.lit(" [Tier "), F.col("source_tier").cast("string"), F.lit("]\nTITLE: "), F.coalesce("title", F.lit("")),
        F.lit("\nURL: "), F.coalesce("url", F.lit("")), F.lit("\nDATE: "), F.coalesce(date, F.lit("unknown")), F.lit("\nRELEVANCE: "), share, F.lit("\nCONTENT:\n"), F.substring("content", 1, size),
    )
    line = F.concat(
        F.lit("  ["), n, F.lit("] "), F.coalesce(T.some(F.col("title")), F.col("source"), F.lit("")), F.lit(" — "), F.coalesce("url", F.lit("")),
        F.lit(" ("), F.coalesce(date, F.lit("date unknown")), F.lit(")")
    )
    chars = F.col("chars") if "chars" in numbered.columns else F.length("content")
    parts = F.array_sort(F.collect_list(F.struct("n", block.alias("block"), line.alias("line"))))
    joined = lambda name, rule: F.array_join(F.transform("parts", lambda x: x[name]), rule).alias({"block": "context", "line": "source_index"}[name])
    out = numbered.groupBy("query_id").agg(parts.alias("parts"), F.count("*").alias("n_sources"), F.sum(chars).cast("long").alias("total_chars"))
    return out.select("query_id", joined("block", RULE), joined("line", "\n"), "n_sources", "total_chars")


def successful(results: DataFrame) -> DataFrame:
    """Results without error that have content."""
    return results.where((F.coalesce("error", F.lit("")) == "") & (F.coalesce("content", F.lit("")) != ""))


def tier_summary(results: DataFrame) -> DataFrame:
    """Of each query the successful results of every tier, with the tier's name."""
    label = F.coalesce(*[F.when(F.col("source_tier") == k, v) for k, v in K.TIER_LABELS.items()], F.concat(F.lit("Tier "), F.col("source_tier").cast("string")))
    return successful(results).groupBy("query_id", "source_tier").agg(F.count("*").alias("n")).withColumn("label", label)


def run_stats(results: DataFrame) -> DataFrame:
    good = F.col("error").isNull()
    out = results.groupBy("query_id").agg(
        F.count("*").alias("checked"), F.sum(good.cast("long")).alias("succeeded"), F.sum(
            F.when(good, F.length("content")).otherwise(0)
        ).cast("long").alias("total_chars")
    )
    return out.withColumn(
        "failed", F.col("checked") - F.col("succeeded")
    ).withColumn("success_rate", F.round(F.col("succeeded") * 100.0 / F.col("checked"), 6))


def official_doc_hits(results: DataFrame, most: int = 5) -> DataFrame:
    """Of each query: the first URLs (by pos) of successful results that look like official documentation, and whether there are any."""
    lower, hit = F.lower("url"), F.lit(False)
    for sign in K.DOC_URL_SIGNS:
        hit = hit | lower.contains(sign)
    rows = successful(results).where(hit)
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy("pos", "url"))).where(F.col("k") <= most)
    found = rows.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "url"))), lambda x: x["url"]), " ").alias("doc_urls")
    )
    out = matched(results.select("query_id").distinct(), found, ["query_id"], "left")
    return out.select("query_id", F.coalesce("doc_urls", F.lit("")).alias("doc_urls"), F.col("doc_urls").isNotNull().alias("has_official_docs"))


def _mapped(results: DataFrame) -> list:
    """An answer's fields of a source: unknown where it has none, score 0 and tier 5 where those are missing or 0."""
    have = lambda name: F.col(name) if name in results.columns else F.lit(None).cast("string")
    text = lambda name, other: F.coalesce(have(name), F.lit(other)).alias(name)
    return [
        "query_id", "pos", text("source", "unknown"), text("url", ""), text("title", ""), F.coalesce("relevance_score", F.lit(0.0)).alias("relevance_score"),
        F.coalesce(F.nullif("source_tier", F.lit(0)), F.lit(5)).alias("source_tier"), have("publication_date").alias("publication_date")
    ]


def map_sources(results: DataFrame, include_content: bool = False, max_chars: int = 8000) -> DataFrame:
    """Results as an answer's sources, with sanitized content (null if empty or not asked for)."""
    text = T.some(T.sanitized(F.col("content"), max_chars)) if include_content else F.lit(None).cast("string")
    return results.select(*_mapped(results), text.alias("content"), "error")


def map_citations(results: DataFrame, max_chars: int = 8000) -> DataFrame:
    """Results without error as citations, with a snippet of their sanitized content."""
    good = results.where("error is null or error = ''")
    return good.select(*_mapped(results), T.snippet(T.sanitized(F.col("content"), max_chars)).alias("snippet"))
