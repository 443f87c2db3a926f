"""Unrelated texts whose doc_id is null or repeated are classes of their own."""

from pagesift.llm import neardup

TEXTS = [
    (None, "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six"), (7, "red green blue white black grey"),
    (7, "north east south west up down"), (None, "same text twice over and again"), (9, "same text twice over and again"), (None, " ")
]


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in neardup.one_of_each(docs).collect()), key=str)
    assert kept == sorted([x for x in TEXTS if x != TEXTS[4]], key=str)
    rows = neardup.near_duplicates(docs).collect()
    assert len({r.class_key for r in rows if r.class_key}) == 5
    assert sorted(r.class_size for r in rows) == [1, 1, 1, 1, 1, 2, 2]
