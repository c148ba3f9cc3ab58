"""Count-Min sketch: cells as rows, so that sketches merge by sum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.functions.hashing import big_endian, seed_bytes, unsigned_mod, word64
from keystrand.plans.dense import dense

SEED = 1000
#: The largest counter that a stored sketch holds.
MOST = 2**32 - 1


def width(epsilon: float) -> int:
    return math.ceil(math.e / epsilon)


def depth(delta: float) -> int:
    return math.ceil(math.log(math.e / delta))


def checked(epsilon: float, delta: float) -> tuple[int, int]:
    if not (0 < epsilon <= 1 and 0 < delta <= 1):
        raise ValueError("epsilon and delta must be above 0 and at most 1")
    return width(epsilon), depth(delta)


def places(element: str | Column, m: int, k: int, seed: int = SEED) -> Column:
    """Array of (row, col): where an element's counters are."""
    return F.array(*[F.struct(F.lit(i).alias("row"), unsigned_mod(word64(element, seed + i), m).alias("col")) for i in range(k)])


def cells(df: DataFrame, element: str, epsilon: float, delta: float, seed: int = SEED) -> DataFrame:
    """Rows (row, col, n); a task sends a row for each cell at most, however many elements it has."""
    return cells_of(df, element, *checked(epsilon, delta), seed)


def cells_of(df: DataFrame, element: str, m: int, k: int, seed: int = SEED) -> DataFrame:
    """As ``cells``, by the numbers of columns and rows."""
    placed = df.where(F.col(element).isNotNull()).select(F.explode(places(element, m, k, seed)).alias("c"))
    return placed.groupBy("c.row", "c.col").agg(F.count(F.lit(1)).alias("n"))


def merge(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("row", "col").agg(F.sum("n").alias("n"))


def estimate(sketch: DataFrame, items: DataFrame, element: str, epsilon: float, delta: float, seed: int = SEED) -> DataFrame:
    """Rows (element, least, most): the least counter is the estimate, the most is for comparison; neither is below the count."""
    return estimate_of(sketch, items, element, *checked(epsilon, delta), seed)


def estimate_of(sketch: DataFrame, items: DataFrame, element: str, m: int, k: int, seed: int = SEED) -> DataFrame:
    """As ``estimate``, by the numbers of columns and rows."""
    asked = items.select(element).distinct().select(F.col(element), F.explode(places(element, m, k, seed)).alias("c")).select(element, "c.row", "c.col")
    met = asked.join(sketch, ["row", "col"], "left").select(element, F.coalesce("n", F.lit(0)).alias("n"))
    return met.groupBy(element).agg(F.min("n").alias("least"), F.max("n").alias("most"))


def payload(sketch: DataFrame, epsilon: float, delta: float, seed: int = SEED) -> DataFrame:
    """The sketch as one binary value: m and k (4 bytes each), the seeds, then k rows of m counters of 4 bytes.

    A counter beyond 4 bytes is stored as the largest there is, so a stored estimate stops at 2**32 - 1.
    """
    return payload_of(sketch, *checked(epsilon, delta), seed)


def payload_of(sketch: DataFrame, m: int, k: int, seed: int = SEED) -> DataFrame:
    """As ``payload``, by the numbers of columns and rows."""
    head = b"".join(seed_bytes(seed + i) for i in range(k))
    cell = F.lpad(F.hex(F.least("n", F.lit(MOST))), 8, "0")
    body = dense(sketch.select((F.col("row").cast("long") * m + F.col("col")).alias("at"), cell.alias("hex")), m * k, "00000000")
    return body.select(F.concat(big_endian(F.lit(m), 4), big_endian(F.lit(k), 4), F.lit(head), "body").alias("payload"))


def parameters(data: bytes) -> tuple[int, int, int]:
    """(m, k, first seed) of a stored sketch."""
    m, k, seed = (int.from_bytes(data[i : i + 4], "big") for i in (0, 4, 8))
    return m, k, seed


def cells_of_payload(rows: DataFrame, m: int, k: int, column: str = "payload") -> DataFrame:
    """Rows (row, col, n) of a stored sketch; cells of 0 are left out."""
    cells = F.regexp_extract_all(F.hex(F.substring(column, 9 + 32 * k, 4 * m * k)), F.lit("(.{8})"), F.lit(1))
    found = rows.select(F.posexplode(cells).alias("at", "hex")).where("hex <> '00000000'")
    return found.select(F.floor(F.col("at") / m).cast("int").alias("row"), (F.col("at") % m).cast("int").alias("col"), F.conv("hex", 16, 10).cast("long").alias("n"))
