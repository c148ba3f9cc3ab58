"""Bloom filter: the set positions as rows, so that filters merge by union."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.functions.hashing import big_endian, seed_bytes, unsigned_mod, word64
from keystrand.plans.dense import dense

SEED = 1000


def bits_for(n: int, p: float) -> int:
    return math.ceil(n * abs(math.log(p)) / math.log(2) ** 2)


def hashes_for(n: int, m: int) -> int:
    return math.ceil(m / n * math.log(2))


def sized(n: int, p: float) -> tuple[int, int]:
    if n < 1 or not 0 < p < 1:
        raise ValueError("n must be at least 1 and p between 0 and 1")
    m = bits_for(n, p)
    return m, hashes_for(n, m)


def places(element: str | Column, m: int, k: int, seed: int = SEED) -> Column:
    return F.array(*[unsigned_mod(word64(element, seed + i), m) for i in range(k)])


def bits(df: DataFrame, element: str, m: int, k: int, seed: int = SEED) -> DataFrame:
    """Rows (bit): the positions that are set; a task sends each once at most, however many elements it has."""
    return df.where(F.col(element).isNotNull()).select(F.explode(places(element, m, k, seed)).alias("bit")).distinct()


def merge(*filters: DataFrame) -> DataFrame:
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.distinct()


def membership(set_bits: DataFrame, items: DataFrame, element: str, m: int, k: int, seed: int = SEED) -> DataFrame:
    """Rows (element, maybe): false for what was certainly never added."""
    asked = items.select(element).distinct().select(element, F.explode(F.array_distinct(places(element, m, k, seed))).alias("bit"))
    met = asked.join(set_bits.withColumn("hit", F.lit(True)), "bit", "left")
    return met.groupBy(element).agg(F.every(F.coalesce("hit", F.lit(False))).alias("maybe"))


def payload(set_bits: DataFrame, m: int, k: int, seed: int = SEED) -> DataFrame:
    """The filter as one binary value: m (4 bytes), a byte for each bit, k (4 bytes), the seeds."""
    if m >= 2**31:
        raise ValueError("a filter of 2**31 bits or more has no serialised form")
    tail = b"".join(seed_bytes(seed + i) for i in range(k))
    body = dense(set_bits.select(F.col("bit").cast("long").alias("at"), F.lit("01").alias("hex")), m, "00")
    return body.select(F.concat(big_endian(F.lit(m), 4), "body", big_endian(F.lit(k), 4), F.lit(tail)).alias("payload"))


def parameters(data: bytes) -> tuple[int, int, int]:
    """(m, k, first seed) of a stored filter."""
    m = int.from_bytes(data[:4], "big")
    return m, int.from_bytes(data[4 + m : 8 + m], "big"), int.from_bytes(data[8 + m : 12 + m], "big")


def bits_of_payload(rows: DataFrame, m: int, column: str = "payload") -> DataFrame:
    """Rows (bit) of a stored filter of m bits."""
    cells = F.regexp_extract_all(F.hex(F.substring(column, 5, m)), F.lit("(..)"), F.lit(1))
    return rows.select(F.posexplode(cells).alias("bit", "hex")).where("hex <> '00'").select("bit")
