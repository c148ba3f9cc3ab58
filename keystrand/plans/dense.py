"""Cells by place as one binary value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense(cells: DataFrame, size: int, empty: str) -> DataFrame:
    """One row (body): the cells (at, hex) from place 0 up to ``size``, ``empty`` where there is none; for what one value can hold."""
    every = cells.sparkSession.range(size).select(F.col("id").alias("at"), F.lit(empty).alias("hex"), F.lit(0).alias("own"))
    filled = cells.select("at", "hex", F.lit(1).alias("own")).unionByName(every).groupBy("at").agg(F.max_by("hex", "own").alias("hex"))
    listed = F.sort_array(F.collect_list(F.struct("at", "hex")))
    return filled.agg(listed.alias("c")).select(F.unhex(F.array_join(F.col("c.hex"), "")).alias("body"))
