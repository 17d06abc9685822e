"""A corpus made ready for training: good documents, one of each group of near copies, without
personal data, packed into sequences.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a
DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starscan.llm import packing, pii, quality, simhash
from starscan.llm.common import stage
from starscan.llm.queries import vocabulary


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the labels, expects to be of the top grade."""
    return quality.select(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of 4-word shingles that differ in 4 bits or fewer."""
    return simhash.keep_one(spark, docs, bits=4, words_per_shingle=4)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, docs, vocabulary("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("quality", select_quality),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: SQL has neither the model nor the tokenizer; the tests compare with a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(spark, function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
