"""Cleans and packs the documents: toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cladewise.llm import packing, secrets, simhash, toxicity
from cladewise.llm.common import shared_folder
from cladewise.llm.queries import SEQUENCE, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain takes for toxic go."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked parts of credentials give way to a mark."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces with their places in full sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), SEQUENCE)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("secrets", redact_secrets), ("packing", pack_sequences)]

#: SQL has no classifier chain and no tokenizer; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
