"""From raw documents to mixed, tokenised training text: five stages, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import stages
from paperloom.session import materialise

STAGES = [
    ("language", stages.language),
    ("near_dedup", stages.near_duplicates),
    ("decontaminate", stages.decontaminated),
    ("mix", stages.mixed),
    ("tokens", stages.tokens),
]

#: Language profiles, sketches and grammars are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, writing and rereading what each returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
