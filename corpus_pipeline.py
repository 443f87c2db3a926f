"""The corpus pipeline: toxic documents go, one document of each group of near duplicates stays, personal data is
masked, sources are mixed to their targets, and what is left is encoded into pieces.

Each stage takes all its predecessor kept. Stages but the last return the columns of documents; n_chars follows the
text. Null texts pass every stage as empty ones do. Repeated rows are one group of copies; documents without words are
kept, each on its own. The mix repeats rows that it takes more than once.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm import mixing, neardup, pieces, pii, toxicity
from pagesift.llm.common import Shelf, table
from pagesift.llm.queries import fold, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score 0.5 or more for toxicity. Labels of the held-out fold stay unused, as in the query."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return toxicity.without_toxic(docs.select(*COLUMNS), model)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near duplicates; of repeated rows of it one."""
    return neardup.one_of_each(docs.select(*COLUMNS))


def personal_data_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind in brackets."""
    masked = pii.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(masked.schema["n_chars"].dataType), "n_chars")).select(*COLUMNS)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_copies(docs.select(*COLUMNS, mixing.quality().alias("weight")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with ids of the best segmentation and scores of the n best."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxic_out),
    ("near duplicates", near_duplicates_out),
    ("personal data", personal_data_masked),
    ("source mixing", sources_mixed),
    ("pieces", encoded),
]

#: Toxicity and near duplicates can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written once; its input is taken down as soon as nothing reads it any more."""
    docs, shelf, before = table(spark, sf_dir, "documents"), Shelf(spark), []
    for _, stage in STAGES[:-1]:
        docs = shelf.save(stage(spark, docs, sf_dir))
        shelf.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
