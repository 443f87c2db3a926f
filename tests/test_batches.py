"""Python holds the objects of a part of a batch at a time; parts are whole and in order."""

import pyarrow as pa
from pyspark.sql import functions as F

from pagesift.functions import text as T
from pagesift.functions.batches import parts


def test_parts():
    texts = ["x" * 700] * 10 + [None, "", "y" * 5_000, None] + ["é" * 400] * 10
    found = [*parts(pa.array(texts).slice(1), 2_000)]
    assert [start for start, _ in found] == [sum(n for _, n in found[:i]) for i in range(len(found))] and sum(n for _, n in found) == len(texts) - 1
    sizes = [[len((t or "").encode()) for t in texts[1:][start : start + n]] for start, n in found]
    assert all(sum(s) <= 2_000 or len(s) == 1 for s in sizes) and len(found) > 5
    assert [*parts(pa.array([], pa.string()))] == []


def test_sanitized_texts_of_many_parts(spark):
    rows = spark.range(0, 600, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("a &amp; "), F.repeat(F.lit("b  c "), F.col("id").cast("int") * 20))).alias("x"))
    got = rows.select("id", "x", T.sanitized(F.col("x"), 8000).alias("s"))
    assert all(r.s == T.sanitize(r.x, 8000) for r in got.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
