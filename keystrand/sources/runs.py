"""Sorted runs of a log: Parquet directories under level=L/run_id=N, and a manifest that says which of them count.

A run is written in full before a new manifest names it, and the manifest is replaced by a rename, so readers see the old set
of runs or the new one.  Keys are sorted within files, and a lower-cased copy of the key is stored, so that both kinds of predicate skip
row groups; the key has Bloom filters.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keystrand.functions.hashing import big_endian
from keystrand.operators import merkle
from keystrand.plans.storage import hadoop, put_bytes, read_bytes

SCHEMA = "key string, value binary, ts timestamp, seq long, tombstone boolean, crc long"


class RunStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> list[dict]:
        found = read_bytes(self.spark, f"{self.path}/manifest.json")
        return json.loads(found) if found else []

    def publish(self, runs: list[dict]) -> None:
        put_bytes(self.spark, f"{self.path}/manifest.json", json.dumps(runs).encode())

    def write(self, rows: DataFrame, level: int) -> dict:
        """Write a run; it does not count before it is published."""
        run_id = max([r["run_id"] for r in self.manifest()], default=0) + 1
        path = f"{self.path}/level={level}/run_id={run_id}-{uuid.uuid4().hex[:8]}"
        kept = rows.select("key", F.lower("key").alias("key_lc"), "value", "ts", "seq", "tombstone", "crc")
        seen = Observation()
        kept = kept.observe(seen, F.count(F.lit(1)).alias("rows"))
        kept.repartitionByRange("key").sortWithinPartitions("key", F.desc("ts"), F.desc("seq")).write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)
        store, where = hadoop(self.spark, path)
        return {"run_id": run_id, "level": level, "path": path, "rows": seen.get["rows"], "bytes": store.getContentSummary(where).getLength()}

    def add(self, rows: DataFrame, level: int = 1) -> dict:
        run = self.write(rows, level)
        self.publish([*self.manifest(), run])
        return run

    def read(self, runs: list[dict] | None = None) -> DataFrame:
        """All rows of the runs, with their level and run_id; never fewer than all levels, or an old version could win."""
        runs = self.manifest() if runs is None else runs
        out = None
        for r in runs:
            part = self.spark.read.parquet(r["path"]).withColumns({"level": F.lit(r["level"]), "run_id": F.lit(r["run_id"])})
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "key string, key_lc string, value binary, ts timestamp, seq long, tombstone boolean, crc long, level int, run_id int")

    def drop_unpublished(self) -> None:
        """Delete run directories that the manifest does not name."""
        named = {r["path"].rsplit("/", 1)[-1] for r in self.manifest()}
        store, where = hadoop(self.spark, self.path)
        for level in store.listStatus(where):
            if level.isDirectory():
                for run in store.listStatus(level.getPath()):
                    if run.getPath().getName() not in named:
                        store.delete(run.getPath(), True)

    def tree(self, runs: list[dict] | None = None) -> DataFrame:
        """The runs' Merkle trees; a leaf is SHA-1 over a row's serialised form."""
        rows = self.read(runs)
        return merkle.tree(merkle.leaves(rows, F.sha1(record_bytes()), ["key", "seq"], F.col("run_id")))

    def altered(self, known: DataFrame) -> DataFrame:
        """Rows (run_id) of runs whose root is not the known one (run_id, root)."""
        now = merkle.roots(self.tree())
        both = known.select("run_id", F.col("root").alias("known")).join(now.select("run_id", "root"), "run_id", "full")
        return both.where(~F.col("known").eqNullSafe(F.col("root"))).select("run_id")


def record_bytes():
    """A row in the 29-byte-header form: checksum, time, tombstone, sizes, key, value."""
    key, value = F.encode("key", "UTF-8"), F.coalesce("value", F.lit(b""))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return F.concat(big_endian(F.col("crc"), 4), big_endian(seconds, 8), big_endian(F.col("tombstone").cast("int"), 1), big_endian(F.octet_length(key), 8), big_endian(F.octet_length(value), 8), key, value)
