"""Load generators: logs of puts over a fixed set of keys, in an order shuffled by a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.operators.log import as_log
from keystrand.plans.numbering import numbered


def load(spark: SparkSession, rows: int, keys: int, first: int = 1, shuffled: bool = True, seed: int = 7) -> DataFrame:
    """``rows`` puts of "TEST" over the keys first .. first + keys - 1; a thousand share a second, so that times tie."""
    named = spark.range(rows).select((F.col("id") % keys + first).cast("string").alias("key"), (F.rand(seed) if shuffled else F.col("id")).alias("o"))
    placed = numbered(named, ["o", "key"], "seq", 1)
    return as_log(placed, F.col("key"), F.lit("TEST"), F.timestamp_seconds(F.floor(F.col("seq") / 1000)), F.col("seq"), F.lit(False))


def load_100(spark: SparkSession) -> DataFrame:
    return load(spark, 100_000, 100)


def load_5000(spark: SparkSession) -> DataFrame:
    return load(spark, 100_000, 5_000)


def load_500(spark: SparkSession) -> DataFrame:
    return load(spark, 500, 500, first=0, shuffled=False)
