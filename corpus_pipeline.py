"""From raw documents to token digests: four stages, each written and read again before the next.

Every stage but the last returns the columns of documents, extra ones too. run() deletes what a stage has read and what it
put aside as soon as its result is written; the last result stays.

Defined results: a null or empty text is scored by the classifier's bias alone, is linked with other texts without words,
holds no item, and has the end id only. Rows that repeat an id are scored each; the near-duplicate stage keeps one of those whose
id stands for their group. Rows without an id are kept by that stage, as no group can name them. Of equal scores, texts and
groups all are treated alike: a tie at the threshold is kept. Empty tables give empty results with the same columns; without
labels the classifier gives every document the same score and no document reaches the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayline.llm import decontaminate, quality, simhash
from wayline.llm.pieces import encode_documents
from wayline.llm.queries import public_model
from wayline.llm.shared import given, release, scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return encode_documents(docs, public_model("piece_bpe_32k.model"))


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", tokenise),
]

#: The classifier is learned, so no SQL gives these rows; tests/llm/test_pipeline.py compares them with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), given()
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, read, keep=path)
        read = given() - 1
        docs = spark.read.parquet(path)
    return docs
