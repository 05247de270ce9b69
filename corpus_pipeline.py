"""Corpus pipeline: documents in, packed sequences out.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame. Each stage works on all that its predecessor kept: poor documents go, one document of
each near-duplicate class stays, secrets are masked, documents of rare domains are repeated to
the target weights, and the rest is packed. All stages but the last return the columns of
documents. No stage fails on nulls, empty tables or repeated rows; the operators say what then
happens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrion.llm import bagminhash, mixing, packing, quality, secrets
from papyrion.llm.common import materialise
from papyrion.llm.entries import domains


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents whose probability of at least grade 1 is under one half go."""
    return quality.select(docs, quality.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each class stays."""
    return bagminhash.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: found secrets are masked."""
    return secrets.redact(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents are repeated by their rates, each at least once."""
    return mixing.resample(docs, domains(spark, docs, sf_dir), least=1.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces with their sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]
#: The classifier, the signatures and the tokeniser are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
