"""Pages: extraction in one pass, flags, and link tables."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagesift import constants as K
from pagesift.functions.batches import parts
from pagesift.functions.html import extract

_LINK = "array<struct<url:string,text:string,title:string>>"
EXTRACTED = f"title string, content string, metadata map<string,string>, internal {_LINK}, external {_LINK}, images array<struct<url:string,alt:string>>"


def extract_pages(pages: DataFrame, scope: str = "body") -> DataFrame:
    """pages(page_id, url, html) with title, content, metadata, links and images, each page parsed once.

    A batch is parsed in parts of about a megabyte of HTML: links and images take many times a page's room in Python.
    """
    out = f"page_id long, url string, {EXTRACTED}"
    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches):
        for whole in batches:
            for start, size in parts(whole.column("html")):
                batch = whole.slice(start, size)
                found = [extract(u, h, scope) for u, h in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)]
                values = {k: [f[k] for f in found] for k in ("title", "content", "metadata", "internal", "external", "images")}
                values["metadata"] = [list(m.items()) for m in values["metadata"]]
                rest = [pa.array(v, schema.field(k).type) for k, v in values.items()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *rest], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, out)


def page_links(extracted: DataFrame) -> DataFrame:
    each = lambda kind: extracted.select("page_id", F.lit(kind).alias("kind"), F.posexplode(kind).alias("pos", "link"))
    return each("internal").unionByName(each("external")).select("page_id", "kind", "pos", "link.url", "link.text", "link.title")


def link_counts(extracted: DataFrame) -> DataFrame:
    return extracted.select("page_id", F.size("internal").alias("n_internal"), F.size("external").alias("n_external"))


def is_challenge(html: Column, status: Column) -> Column:
    """Whether a page is a bot challenge instead of content."""
    h = F.lower(html)
    out = h.contains("cloudflare") & (h.contains("ray id") | status.isin(403, 503))
    for s in K.CHALLENGE_SIGNS:
        out = out | h.contains(s)
    return F.coalesce(out, F.lit(False))


def prefer_rescrapes(base: DataFrame, again: DataFrame) -> DataFrame:
    """base(url, content, error), where a further scrape without error and with longer content wins: the longest of several,
    of equally long ones the greatest in code-point order."""
    size = F.length(F.trim("content"))
    b = again.where("error is null and content is not null").groupBy("url").agg(F.max_by("content", F.struct(size, "content")).alias("c2"))
    longer = F.length(F.trim("c2")) > F.length(F.trim(F.coalesce("content", F.lit(""))))
    rows = base.join(b, "url", "left")
    return rows.withColumn(
        "error", F.when(longer, None).otherwise(F.col("error"))
    ).withColumn("content", F.when(longer, F.col("c2")).otherwise(F.col("content"))).drop("c2")
