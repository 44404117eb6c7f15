"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and reread."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontamination, quality, sentencepiece, simhash, toxicity
from graphloom.llm.common import remove_dir, table
from graphloom.plans.lineage import shared_dir


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality model gives a fair chance of the best grade."""
    return quality.select(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below the threshold."""
    return toxicity.remove_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of SimHash near-duplicates."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, ids_crc32, viterbi_n, viterbi_crc32, round_trip): each kept document encoded and decoded."""
    return sentencepiece.digests(docs)


STAGES = [
    ("quality", select_quality),
    ("toxicity", drop_toxic),
    ("dedup", dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: The models and hashes of the stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written to the shared folder, reread, and removed once used."""
    out = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, used = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{out}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if used is not None:
            remove_dir(spark, used)
        docs, used = spark.read.parquet(path), path
    return docs
