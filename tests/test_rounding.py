"""Shares are rounded as the SQL rounds them."""

import duckdb
from pyspark.sql import functions as F

from pagesift.functions.numbers import half_even
from pagesift.operators import results


def test_halves_to_even_like_the_sql(spark):
    shares = spark.range(1, 201).select(F.col("id").alias("t")).select("t", F.explode(F.sequence(F.lit(0).cast("long"), "t")).alias("k"))
    got = shares.select("k", "t", *(half_even(F.col("k") / F.col("t"), d).alias(f"d{d}") for d in (2, 3, 4)))
    want = duckdb.sql("SELECT k, t, round_even(k / t, 2), round_even(k / t, 3), round_even(k / t, 4) FROM (SELECT t, unnest(range(0, t + 1)) AS k FROM range(1, 201) r(t))")
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_relevance_of_23_in_40_words(spark):
    """0.575 is a little less than its half as a double."""
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    asked = spark.createDataFrame([(1, " ".join(words))], "query_id long, query string")
    found = spark.createDataFrame([(1, 0, " ".join(words[:23]))], "query_id long, pos long, content string")
    assert results.with_relevance(found, asked).first().relevance_score == 0.57
