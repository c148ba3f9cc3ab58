"""What the training-data operators share: shared storage, ordered chunks of documents, packed columns."""

from __future__ import annotations

import bisect
import ctypes
import math
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.plans.shipping import ship
from keystrand.plans.storage import delete, fresh_path

#: Text bytes that one ordered chunk aims at; a task holds one chunk at a time.
CHUNK_BYTES = 16_000_000


#: Rows and bytes of an Arrow batch to or from a Python worker, unless the session says otherwise.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4000000"}


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and bound what a worker is handed at a time."""
    ship(spark)
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


@cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def lean(run):
    """A task's function that hands freed memory back to the system after each batch it makes."""

    @wraps(run)
    def batch_by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in run(batches):
            yield made
            del made
            pa.default_memory_pool().release_unused()
            if _trim():
                _trim()(0)

    return batch_by_batch


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's; the package goes to the workers with it."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_held: dict = {}


def held(key: tuple, make):
    """What a Python worker keeps from one task to the next: one object, dropped as soon as another kind is asked for."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def as_binary(rows: list[bytes | None]) -> pa.Array:
    return pa.array(rows, pa.binary())


def slices(texts: list[str | None], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``chars`` code points, one text at least."""
    at = size = 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def ordered_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, carry: tuple[str, ...] = ()) -> tuple[DataFrame, list[int]]:
    """Deal documents to chunks of ascending id ranges.

    Returns rows (chunk int, doc_id long, tie binary, ztext binary) and the upper bounds of the ranges.  Chunk c
    holds the ids above bound c-1 up to bound c; null ids are in chunk 0.  ``ztext`` is the UTF-8 text
    under zstd, null where the text is null, so that a later shuffle moves compressed rows; ``tie``, the text's 128-bit hash
    (null for null), orders rows that share an id, whatever the compressor makes of them.  Bounds come from one
    aggregate pass over ids and text lengths; their number follows the text's size.  Columns named in ``carry`` come
    along as carry0, carry1, and so on.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"carry{k}") for k, c in enumerate(carry)])
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("doc_id").alias("n")).first()
    n = max(1, min(math.ceil((size["b"] or 0) / chunk_bytes), size["n"]))
    bounds: list[int] = []
    if n > 1:
        cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q")).first()["q"]
        bounds = sorted(set(cuts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, press = np.array(bounds, dtype=np.int64), zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids = b.column(0)
            chunk = np.searchsorted(edges, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), side="left").astype(np.int32)
            texts = b.column(1).cast(pa.binary()).to_pylist()
            ties, packed = ([None if t is None else f(t) for t in texts] for f in (xxhash.xxh3_128_digest, press.compress))
            yield pa.RecordBatch.from_arrays([pa.array(chunk), ids, as_binary(ties), as_binary(packed), *b.columns[2:]], names=["chunk", "doc_id", "tie", "ztext", *b.schema.names[2:]])

    extra = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    return docs.mapInArrow(lean(deal), "chunk int, doc_id long, tie binary, ztext binary" + extra), bounds


def chunk_of(bounds: list[int], doc_id: int | None) -> int:
    return 0 if doc_id is None else bisect.bisect_left(bounds, doc_id)


def by_chunk(chunks: DataFrame, n: int, order: list[str]) -> DataFrame:
    """One partition per chunk, each sorted by ``order``."""
    return chunks.repartitionById(n, F.col("chunk")).sortWithinPartitions("chunk", *order)


def unzipped(rows: list[bytes | None]) -> list[bytes]:
    """Texts of ``ztext``; null as empty."""
    get = zstandard.ZstdDecompressor().decompress
    return [b"" if r is None else get(r) for r in rows]
