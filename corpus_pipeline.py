"""Corpus pipeline over ``documents``: five stages, each calling one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slatework.llm import decontam, mixing, sharding, simhash, toxicity
from slatework.llm.common import stored, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("simhash near-dedup", simhash.stage),
    ("benchmark decontamination", decontam.stage),
    ("mixing to target weights", mixing.stage),
    ("sharding", sharding.stage),
]

# The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
