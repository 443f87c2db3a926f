"""a3_lists against its SQL, on texts that begin with a list item, too."""

import duckdb

from pagesift import catalog


def test_texts_that_begin_with_an_item(spark, tmp_path):
    texts = ["56.187 x\n1. y", "- a\n\n- b", " • c", "plain\n- d", "", None, "x\n", "x  "]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, catalog.QUERIES["a3_lists"](spark, str(tmp_path)).collect())) == sorted(c.execute(catalog.ORACLE_SQL["a3_lists"]).fetchall())
