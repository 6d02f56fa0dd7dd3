"""The corpus pipeline: rejected documents go, near-duplicates go, secrets are masked, sources mixed, sequences packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionlake.llm import mixing, packing, quality, secrets, simhash
from sessionlake.llm.common import materialize, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group, on 5-word shingles."""
    return simhash.keep_first(docs, shingle=5)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of small sources up to twice as often as those of the largest."""
    return mixing.mix(docs, max_repeats=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and places."""
    return packing.pack(docs)


STAGES = [("quality", classify), ("near_dedup", deduplicate), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]
#: The classifier, fingerprints and tokens are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


