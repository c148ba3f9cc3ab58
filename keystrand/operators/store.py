"""A store: the log of late mutations and the sorted runs below it, read as one and kept in shape by the settings.

Mutations are appended to the log in batches.  Once the log holds ``MaxSize`` * ``NumberOfMemtables`` different keys it is
flushed: the newest row of each key becomes a run of level 1, runs are compacted as far as the settings say, and the flushed
batches go.  A run is published before its batches go, so a failure between the two leaves rows twice, which changes no read.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from keystrand.config import Settings
from keystrand.operators import log, read
from keystrand.operators.compaction import compact
from keystrand.plans.storage import delete, hadoop, put_bytes, read_bytes
from keystrand.sources.runs import SCHEMA, RunStore


class Store:
    """``path`` keeps the settings that the store was made with; later ones may be given when it is opened."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.runs = RunStore(spark, f"{self.path}/runs")
        known = read_bytes(spark, f"{self.path}/settings.json")
        self.settings = settings or (Settings.from_json(known.decode()) if known else Settings())
        put_bytes(spark, f"{self.path}/settings.json", self.settings.to_json().encode())
        self.cached: OrderedDict[str, Row | None] = OrderedDict()

    def batches(self) -> list[int]:
        store, where = hadoop(self.spark, f"{self.path}/log")
        if not store.exists(where):
            return []
        return sorted(int(s.getPath().getName().removeprefix("batch=")) for s in store.listStatus(where) if s.isDirectory())

    def late(self) -> DataFrame:
        """The log's rows."""
        paths = [f"{self.path}/log/batch={n}" for n in self.batches()]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def rows(self) -> DataFrame:
        """All rows, with the lower-cased key that the runs hold."""
        return self.runs.read().select(*log.COLUMNS, "key_lc").unionByName(self.late().withColumn("key_lc", F.lower("key")))

    def append(self, rows: DataFrame) -> None:
        """Append rows of a log, and flush if the log is full.

        They must not be older than what was appended before: compaction may have dropped the tombstone that would hide them.
        """
        n = max(self.batches(), default=-1) + 1
        rows.select(*[F.col(c).cast("timestamp") if c == "ts" else F.col(c) for c in log.COLUMNS]).write.parquet(f"{self.path}/log/batch={n}")
        self.cached.clear()
        if self.late().select("key").distinct().count() >= self.settings.MaxSize * self.settings.NumberOfMemtables:
            self.flush()

    def put(self, rows: DataFrame) -> None:
        """Put rows (key, value, ts)."""
        self._add(log.put, rows)

    def delete(self, rows: DataFrame, strict: bool = False) -> None:
        """Delete rows (key, ts)."""
        self._add(lambda whole, own: log.delete(whole, own, strict), rows)

    def _add(self, change, rows: DataFrame) -> None:
        whole = self.rows().drop("key_lc")
        last = whole.agg(F.max("seq")).first()[0] or 0
        self.append(change(whole, rows.withColumn("ts", F.col("ts").cast("timestamp"))).where(F.col("seq") > last))

    def flush(self) -> int:
        """Make the log a run and compact; returns the merges."""
        flushed = self.batches()
        if not flushed:
            return 0
        self.runs.add(log.latest(log.valid(self.late())))
        done = compact(self.runs, self.settings)
        for n in flushed:
            delete(self.spark, f"{self.path}/log/batch={n}")
        return done

    def live(self, include_reserved: bool = False) -> DataFrame:
        return log.live(self.rows(), include_reserved).drop("key_lc")

    def get(self, key: str, include_reserved: bool = False) -> DataFrame:
        return read.get(self.rows(), key, include_reserved).drop("key_lc")

    def lookup(self, key: str) -> Row | None:
        """The key's live row; the last ``CacheMaxSize`` answers are kept until the next write."""
        if key not in self.cached:
            self.cached[key] = self.get(key).first()
            if len(self.cached) > self.settings.CacheMaxSize:
                self.cached.popitem(last=False)
        self.cached.move_to_end(key)
        return self.cached[key]

    def multi_get(self, requests: DataFrame) -> DataFrame:
        return read.multi_get(self.rows(), requests).drop("key_lc")

    def prefix_scan(self, prefix: str, case_sensitive: bool = False) -> DataFrame:
        return read.prefix_scan(self.rows(), prefix, case_sensitive, folded="key_lc").drop("key_lc")

    def range_scan(self, low: str, high: str, case_sensitive: bool = False) -> DataFrame:
        return read.range_scan(self.rows(), low, high, case_sensitive, folded="key_lc").drop("key_lc")
