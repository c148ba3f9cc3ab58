"""Row numbers over a whole table without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrand.plans.storage import written


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """Add ``name``: long, from ``first`` in the order of the columns.

    Rows are sorted in ranges and written once, each with its range and its place there; the ranges' sizes, one row each, are
    summed up and joined back.  The columns travel as one struct, so no name can clash.
    """
    keys = [f"o{k}" for k in range(len(order))]
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys, strict=True)])
    placed = whole.repartitionByRange(*keys).sortWithinPartitions(*keys).select("row", F.monotonically_increasing_id().alias("at"))
    kept = written(placed, "numbered").select("row", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit(2**33 - 1)).alias("place"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.col("start") + F.col("place") + F.lit(first).cast("long")
    return kept.join(F.broadcast(starts), "range").select(*[F.col("row").getField(c).alias(c) for c in rows.columns], number.cast("long").alias(name))
