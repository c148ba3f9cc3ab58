"""HyperLogLog: registers as rows, so that sketches merge by maximum.

The bucket of an element is its hash's highest p bits, its rank the hash's trailing zeros and one; a bucket without a row
has rank 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.functions.hashing import big_endian, top_bits, trailing_zeros, word64
from keystrand.plans.dense import dense


def checked_precision(p: int) -> int:
    if not 0 <= p <= 16:
        raise ValueError("precision must be 0 to 16")
    return p


def registers(df: DataFrame, element: str | Column, p: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*by, bucket, rank).  Null elements are not counted."""
    checked_precision(p)
    h = word64(F.col(element) if isinstance(element, str) else element)
    hashed = df.select(*by, h.alias("h")).where("h is not null")
    return hashed.select(*by, top_bits(F.col("h"), p).alias("bucket"), (trailing_zeros(F.col("h")) + 1).alias("rank")).groupBy(*by, "bucket").agg(F.max("rank").alias("rank"))


def merge(*sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy(*by, "bucket").agg(F.max("rank").alias("rank"))


def estimate(sketch: DataFrame, p: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*by, estimate): the harmonic mean, linear counting while registers are empty, the correction of large ranges."""
    m = 1 << checked_precision(p)
    alpha = 0.7213 / (1 + 1.079 / m)
    sums = sketch.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count(F.lit(1)).alias("n"))
    empty = F.lit(m) - F.col("n")
    raw = F.lit(alpha * m * m) / (F.coalesce("s", F.lit(0.0)) + empty)
    rows = sums.select(*by, empty.alias("empty"), raw.alias("e"))
    small = F.lit(float(m)) * F.log(F.lit(float(m)) / F.col("empty"))
    large = F.lit(-float(2**32)) * F.log(1 - F.col("e") / float(2**32))
    out = F.when((F.col("e") <= 2.5 * m) & (F.col("empty") > 0), small).when(F.col("e") > 2.0**32 / 30, large).otherwise(F.col("e"))
    return rows.select(*by, out.alias("estimate"))


def estimate_native(df: DataFrame, element: str, by: tuple[str, ...] = (), relative_error: float = 0.02) -> DataFrame:
    """Spark's own sketch, for speed; other numbers."""
    return df.groupBy(*by).agg(F.approx_count_distinct(element, relative_error).cast("double").alias("estimate"))


def payload(sketch: DataFrame, p: int) -> DataFrame:
    """The sketch as one binary value: number of registers (8 bytes), precision (1), a byte each."""
    m = 1 << checked_precision(p)
    body = dense(sketch.select(F.col("bucket").cast("long").alias("at"), F.lpad(F.hex("rank"), 2, "0").alias("hex")), m, "00")
    return body.select(F.concat(big_endian(F.lit(m), 8), big_endian(F.lit(p), 1), "body").alias("payload"))


def registers_of_payload(rows: DataFrame, column: str = "payload") -> DataFrame:
    cells = F.regexp_extract_all(F.hex(F.substring(column, 10, 2**30)), F.lit("(..)"), F.lit(1))
    return rows.select(F.posexplode(F.transform(cells, lambda c: F.conv(c, 16, 10).cast("int"))).alias("bucket", "rank")).where("rank > 0")
