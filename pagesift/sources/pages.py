"""Tables of fetched pages, at rest or as files arrive."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "page_id long, url string, html string, status_code int"


def read_pages(spark: SparkSession, path: str, kind: str = "parquet", streaming: bool = False) -> DataFrame:
    """page_id, url, html and status_code (null where the files lack it) of Parquet or JSON-lines files, as they are or as they arrive."""
    reader = spark.readStream if streaming else spark.read
    return reader.format(kind).schema(SCHEMA).load(path)
