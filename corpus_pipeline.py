"""Corpus stages over ``documents``, one after another; each is written as Parquet and read again as the next one's input.

1. toxicity: documents that the classifier chain finds toxic go.
2. near_dedup: of every group of near-duplicates the document with the least id stays.
3. decontamination: documents that hold a benchmark item (question and answer) go.
4. pii: personal data in the texts is replaced by format-preserving pseudonyms.
5. packing: the rest is tokenized and packed into training sequences (one row per piece).

All stages but the last return the columns of their input. Rows that a stage cannot judge (null text) stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusfit.llm import decontam, near_dup, packing, pii, toxicity
from corpusfit.llm.queries import PSEUDONYM_KEY
from corpusfit.scale import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.train(docs, labels, toxicity.categories_of_labels())
    return toxicity.keep_clean(docs, chain, "toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(docs, PSEUDONYM_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: Hash functions, a trained classifier and a tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{at}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
