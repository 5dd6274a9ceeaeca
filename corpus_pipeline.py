"""The corpus pipeline: stages over `documents`, each written as Parquet and read as the next one's input.

Every stage but the last returns the columns of its input. A stage's decisions
take effect: what it rejects is gone for the next one, and what the mix takes
twice is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import exact_dedup, mixing, near_dedup, packing, quality
from strandline.session import scratch, staged, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (4): documents that it rejects go."""
    return quality.accepted(docs, quality.fitted(docs, table(spark, sf_dir, "labels")))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (2): of equal texts one stays."""
    return exact_dedup.without_copies(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (1): one document of each group stays."""
    return near_dedup.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing (3): sources by target weights, whole documents, repeated for a second epoch."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (7): pieces of at most 2,048 tokens, each in its sequence."""
    return packing.packed(packing.pieces(docs, packing.tokenizer_path()))


STAGES = [("quality", good), ("exact_dedup", first_copies), ("near_dedup", apart), ("mix", mix), ("pack", pack)]

#: SQL can't express a trained model or a tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` one after the other; what a stage leaves in the scratch folder goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return docs
