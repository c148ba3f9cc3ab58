"""The mutation log: puts and deletes as rows, and the state that the newest of each key make.

Columns: key string, value binary, ts timestamp, seq long (unique, rising), tombstone boolean, crc long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.functions.hashing import record_crc
from keystrand.functions.keys import is_reserved
from keystrand.plans.numbering import numbered

COLUMNS = ("key", "value", "ts", "seq", "tombstone", "crc")


def as_log(df: DataFrame, key: Column, value: Column, ts: Column, seq: Column, tombstone: Column) -> DataFrame:
    """Name the parts of a mutation log and add each row's checksum."""
    out = df.select(key.cast("string").alias("key"), value.cast("binary").alias("value"), ts.alias("ts"), seq.cast("long").alias("seq"), tombstone.alias("tombstone"))
    return out.withColumn("crc", record_crc())


def checked_key(key: str) -> str:
    if not key or key.startswith("tb_"):
        raise ValueError("a key must not be empty or start with tb_")
    return key


def put(log: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows (key, value, ts): seq goes on from the log's highest, in the order of ts and key."""
    return _append(log, rows.select("key", F.col("value").cast("binary").alias("value"), "ts"), False)


def delete(log: DataFrame, rows: DataFrame, strict: bool = False) -> DataFrame:
    """Append tombstones for rows (key, ts); strict: raise if one of the keys is not live."""
    if strict and not rows.join(live(log, include_reserved=True), "key", "left_anti").isEmpty():
        raise KeyError("a key to delete is not there")
    return _append(log, rows.select("key", F.lit(None).cast("binary").alias("value"), "ts"), True)


def _append(log: DataFrame, rows: DataFrame, tombstone: bool) -> DataFrame:
    bad = rows.where(F.col("key").isNull() | (F.col("key") == "") | F.col("key").startswith("tb_"))
    if not bad.isEmpty():
        raise ValueError("a key must not be null, empty or start with tb_")
    last = log.agg(F.max("seq")).first()[0] or 0
    ordered = numbered(rows, ["ts", "key"], "seq", last + 1)
    return log.unionByName(as_log(ordered, F.col("key"), F.col("value"), F.col("ts"), F.col("seq"), F.lit(tombstone)))


def valid(log: DataFrame) -> DataFrame:
    """Rows whose checksum holds; a corrupt row must go before it can win as the newest."""
    return log.where(F.col("crc") == record_crc())


def latest(log: DataFrame) -> DataFrame:
    """The newest row of each key, tombstones included: one aggregation, combined before the shuffle."""
    rest = [c for c in log.columns if c != "key"]
    newest = F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("r")
    return log.groupBy("key").agg(newest).select("key", "r.*")


def live(log: DataFrame, include_reserved: bool = False) -> DataFrame:
    """The current state: the newest row of each key unless it is a tombstone.

    Filters on the key reach the scan; filters on what a row holds stay above the aggregation.
    """
    return visible(latest(log if include_reserved else log.where(~is_reserved())))


def visible(newest: DataFrame) -> DataFrame:
    return newest.where(~F.col("tombstone"))


def dictionary(log: DataFrame) -> DataFrame:
    """Rows (id, key): ids by first appearance."""
    first = log.groupBy("key").agg(F.min("seq").alias("first"))
    return numbered(first, ["first", "key"], "id").select("id", "key")


def encode_keys(log: DataFrame, ids: DataFrame) -> DataFrame:
    return log.join(ids, "key").drop("key")


def decode_keys(encoded: DataFrame, ids: DataFrame) -> DataFrame:
    return encoded.join(ids, "id").drop("id")


def dictionary_json(ids: DataFrame) -> DataFrame:
    """The dictionary as one JSON object; for dictionaries of a size that one value can hold."""
    return ids.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("id").cast("string"), "key"))))).alias("json"))


def dictionary_of_json(rows: DataFrame, column: str = "json") -> DataFrame:
    return rows.select(F.explode(F.from_json(column, "map<string,string>")).alias("id", "key")).select(F.col("id").cast("long"), "key")
