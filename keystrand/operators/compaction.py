"""Size-tiered and levelled compaction of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.config import Settings
from keystrand.operators.log import latest, valid, visible
from keystrand.sources.runs import RunStore


def merged(runs: DataFrame, drop_tombstones: bool) -> DataFrame:
    """The newest row of each key among the runs.  A tombstone may go only if no deeper run can hold its key."""
    newest = latest(valid(runs.select("key", "value", "ts", "seq", "tombstone", "crc")))
    return visible(newest) if drop_tombstones else newest


def level_sizes(runs: DataFrame) -> DataFrame:
    """Rows (level, runs, bytes) from a table of runs (level, bytes)."""
    return runs.groupBy("level").agg(F.count(F.lit(1)).alias("runs"), F.sum("bytes").alias("bytes"))


def due(sizes: DataFrame, settings: Settings) -> DataFrame:
    """Add ``due``: a level of two runs or more that has reached its threshold, which grows with the level."""
    reached = F.col("bytes") >= settings.MaxBytesSSTables * F.col("level") if settings.CompactBy == "byte" else F.col("runs") >= settings.MaxTables * F.col("level")
    return sizes.withColumn("due", (F.col("level") < settings.NumberOfLevels) & (F.col("runs") >= 2) & reached)


def _is_due(runs: list[dict], level: int, settings: Settings) -> bool:
    own = [r for r in runs if r["level"] == level]
    size = sum(r["bytes"] for r in own) if settings.CompactBy == "byte" else len(own)
    return len(own) >= 2 and size >= (settings.MaxBytesSSTables if settings.CompactBy == "byte" else settings.MaxTables) * level


def size_tiered(store: RunStore, settings: Settings) -> int:
    """Merge each level that is due into one run of the next, from level 1 on; stop at the first that is not.  Returns the merges."""
    done = 0
    for level in range(1, settings.NumberOfLevels):
        runs = store.manifest()
        if not _is_due(runs, level, settings):
            break
        own, rest = [r for r in runs if r["level"] == level], [r for r in runs if r["level"] != level]
        deepest = not any(r["level"] > level for r in rest)
        new = store.write(merged(store.read(own), deepest), level + 1)
        store.publish([*rest, new])
        done += 1
    store.drop_unpublished()
    return done


def leveled(store: RunStore, settings: Settings) -> int:
    """As size-tiered, but a level's merge takes in the next level's runs whose keys overlap, so below level 1 runs never do."""
    done = 0
    for level in range(1, settings.NumberOfLevels):
        runs = store.manifest()
        if not _is_due(runs, level, settings):
            break
        own = [r for r in runs if r["level"] == level]
        low, high = store.read(own).agg(F.min("key"), F.max("key")).first()
        meets = [r for r in runs if r["level"] == level + 1 and not store.read([r]).where(F.col("key").between(low, high)).isEmpty()]
        rest = [r for r in runs if r not in own and r not in meets]
        deepest = not any(r["level"] > level + 1 for r in rest)
        new = store.write(merged(store.read([*own, *meets]), deepest), level + 1)
        store.publish([*rest, new])
        done += 1
    store.drop_unpublished()
    return done


def compact(store: RunStore, settings: Settings) -> int:
    return (size_tiered if settings.CompactType == "size_tiered" else leveled)(store, settings)
