"""Streams into logs and sketches.

Each micro-batch is reduced by the same DataFrame code as a batch job and written under its batch id, overwriting what an
earlier attempt left; reading merges the batches.  So results are exact after any failure, and no state grows in executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keystrand.operators import cms, hll
from keystrand.operators.log import latest
from keystrand.plans.storage import delete, hadoop


def source(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream over a directory (or file) of Parquet, with the schema that its files have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    path = path.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern for this one path: a stream's plain path must be a directory
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(pattern)


def start(stream: DataFrame, reduce: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run over what is there now; write each batch's reduction under ``path``/batch=N."""

    def write(rows: DataFrame, batch: int) -> None:
        reduce(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of mutations to a log."""
    return start(stream, lambda rows: rows, path, checkpoint)


def upsert(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest row of each key; read with ``upserted``."""
    return start(stream, latest, path, checkpoint)


def _batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def upserted(spark: SparkSession, path: str) -> DataFrame:
    return latest(_batches(spark, path))


def hll_sketch(stream: DataFrame, element: str, p: int, path: str, checkpoint: str) -> StreamingQuery:
    return start(stream, lambda rows: hll.registers(rows, element, p), path, checkpoint)


def hll_registers(spark: SparkSession, path: str) -> DataFrame:
    return hll.merge(_batches(spark, path))


def cms_sketch(stream: DataFrame, element: str, epsilon: float, delta: float, path: str, checkpoint: str) -> StreamingQuery:
    return start(stream, lambda rows: cms.cells(rows, element, epsilon, delta), path, checkpoint)


def cms_cells(spark: SparkSession, path: str) -> DataFrame:
    return cms.merge(_batches(spark, path))


def truncate(spark: SparkSession, path: str, below: int) -> int:
    """Drop the batches numbered below ``below`` from a log, once a run holds them; returns how many went."""
    store, where = hadoop(spark, path)
    old = [s.getPath() for s in store.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith("batch=") and int(s.getPath().getName()[6:]) < below]
    for p in old:
        delete(spark, p.toString())
    return len(old)
