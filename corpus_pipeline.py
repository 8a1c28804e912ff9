"""Corpus pipeline: classifier, rules, near-duplicates, secrets, packing; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lurewatch.llm.common import scratch, table
from lurewatch.llm.near_dedup import keep_one_of_each
from lurewatch.llm.packing import pack_documents
from lurewatch.llm.quality_classifier import keep_good
from lurewatch.llm.quality_rules import keep_by_rules
from lurewatch.llm.secret_scan import hide_live_secrets

STAGES = [
    ("quality classifier", keep_good),
    ("quality rules", keep_by_rules),
    ("near-duplicates", keep_one_of_each),
    ("secrets", hide_live_secrets),
    ("packing", pack_documents),
]

#: The first stage's model is trained, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the pieces of all documents that stay; every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
