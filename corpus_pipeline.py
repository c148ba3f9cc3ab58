"""The corpus pipeline: stages that each take and return documents, the last one packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keystrand.llm import pipeline

STAGES = pipeline.STAGES
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(spark, sf_dir)
