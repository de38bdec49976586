"""A corpus from raw documents to packed sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemark.llm.common import materialise
from pagemark.llm.packing import best_fit_pack
from pagemark.llm.pii import redact_texts
from pagemark.llm.quality_rules import keep_good
from pagemark.llm.simhash import near_dedup
from pagemark.llm.toxicity import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; labels come from the table of that name."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked in their texts."""
    return redact_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training sequences."""
    return best_fit_pack(docs)


STAGES = [("quality_rules", quality), ("toxicity", toxicity), ("simhash_dedup", dedup), ("pii", privacy), ("packing", packing)]

#: The toxicity network has no SQL form; tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
