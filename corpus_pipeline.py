"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next.

Every stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all its predecessor kept. All but
the last return the columns of documents, whatever these are called; the last returns the encoded documents. An empty
table goes through as an empty table. A row without id is judged by no stage but kept by all; rows that repeat an id
stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.deploy import ship
from millrace.llm._scratch import new_path, temporary
from millrace.llm.decontamination import drop_contaminated
from millrace.llm.exact_dedup import drop_exact_duplicates
from millrace.llm.language_id import drop_unknown
from millrace.llm.minhash_dedup import drop_near_duplicates
from millrace.llm.sentencepiece_codec import encode_documents, model_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language; null and empty texts and texts without letters are in none.

    The column lang trains the models and is no evidence itself; source takes the host's part. Ties go to a language.
    """
    ship(spark)
    return drop_unknown(docs, label_col="lang", declared_col=None)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each class of equal texts; null and empty texts are equal."""
    ship(spark)
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each near-duplicate component; a text without words is linked with none."""
    ship(spark)
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a benchmark item; items without id or text count for nothing."""
    ship(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (with an end id) of what is left, and the text decoded from them: doc_id, ids, decoded, a row for each row."""
    ship(spark)
    return encode_documents(docs, model_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Language models, components and token ids have no form in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's own tables go when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
