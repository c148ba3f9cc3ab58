"""Readers and writers of the binary record formats; integers are big-endian.

Log segments hold records one after another, a record possibly cut by a segment's end.  Table files hold records in one of
four layouts: with or without a dictionary for keys, tombstones without a value.  Rows whose checksum fails are dropped.
Spark's binaryFile source reads the bytes, so any file system will do.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, value binary, ts long, tombstone boolean, crc long"


def checksum(ts: int, tombstone: bool, key: bytes, value: bytes) -> int:
    return zlib.crc32(struct.pack(">q?qq", ts, tombstone, len(key), len(value)) + key + value)


def log_record(key: bytes, value: bytes, ts: int, tombstone: bool) -> bytes:
    return struct.pack(">Iq?qq", checksum(ts, tombstone, key, value), ts, tombstone, len(key), len(value)) + key + value


def table_record(key: bytes, value: bytes, ts: int, tombstone: bool, key_id: int | None = None) -> bytes:
    """key_id: the key's number in the dictionary of a compressed table."""
    head = struct.pack(">Iq?", checksum(ts, tombstone, key, value), ts, tombstone)
    if key_id is None:
        return head + (struct.pack(">q", len(key)) + key if tombstone else struct.pack(">qq", len(key), len(value)) + key + value)
    number = struct.pack(">H", key_id)
    return head + struct.pack(">H", len(number)) + (number if tombstone else struct.pack(">q", len(value)) + number + value)


def parse_log(data: bytes) -> Iterator[tuple[bytes, bytes, int, bool, int]]:
    """Records of a log, as far as it is whole."""
    at = 0
    while at + 29 <= len(data):
        crc, ts, tombstone, k, v = struct.unpack_from(">Iq?qq", data, at)
        end = at + 29 + k + v
        if k < 0 or v < 0 or end > len(data):
            return
        key, value = data[at + 29 : at + 29 + k], data[at + 29 + k : end]
        if checksum(ts, tombstone, key, value) == crc:
            yield key, value, ts, tombstone, crc
        at = end


def parse_table(data: bytes, names: dict[int, str] | None = None) -> Iterator[tuple[bytes, bytes, int, bool, int]]:
    """Records of a table file; names: the dictionary if the file is compressed.

    A tombstone's checksum covers the value that its record doesn't hold, so it can only be checked for an empty value
    and is kept otherwise.
    """
    at = 0
    while at + 15 <= len(data):
        crc, ts, tombstone = struct.unpack_from(">Iq?", data, at)
        at += 13
        k = struct.unpack_from(">H" if names is not None else ">q", data, at)[0]
        at += 2 if names is not None else 8
        v = 0
        if not tombstone:
            v = struct.unpack_from(">q", data, at)[0]
            at += 8
        if k < 0 or v < 0 or at + k + v > len(data):
            return
        key, value = data[at : at + k], data[at + k : at + k + v]
        at += k + v
        if names is not None:
            key = names.get(int.from_bytes(key, "big"), "").encode()
        if tombstone or checksum(ts, tombstone, key, value) == crc:
            yield key, value, ts, tombstone, crc


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    keys, values, ts, dead, crc = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array([k.decode("utf-8", "replace") for k in keys], pa.string()), pa.array(list(values), pa.binary()), pa.array(list(ts), pa.int64()), pa.array(list(dead), pa.bool_()), pa.array(list(crc), pa.int64())], names=["key", "value", "ts", "tombstone", "crc"])


def read_log(spark: SparkSession, directory: str) -> DataFrame:
    """Rows of the log whose segments wal_NNN.log lie in a directory; a log goes to one task, as a record may cross segments."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "wal_*.log").load(directory)
    whole = files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("log")).agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "content"))), lambda s: s["content"]).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for parts in b.column(0).to_pylist():
                yield _batch(list(parse_log(b"".join(parts))))

    return whole.select("parts").mapInArrow(run, SCHEMA)


def read_tables(spark: SparkSession, path: str, dictionary_json: str | None = None) -> DataFrame:
    """Rows of table files; dictionary_json: {"number": "key"} if they are compressed.  A file goes to one task."""
    names = None if dictionary_json is None else {int(k): v for k, v in json.loads(dictionary_json).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                yield _batch(list(parse_table(content, names)))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def parse_bloom(data: bytes) -> tuple[int, list[int], list[bytes]]:
    """(m, set positions, seeds)."""
    m = struct.unpack_from(">I", data)[0]
    k = struct.unpack_from(">I", data, 4 + m)[0]
    return m, [i for i, x in enumerate(data[4 : 4 + m]) if x], [data[8 + m + 32 * i : 40 + m + 32 * i] for i in range(k)]


def parse_cms(data: bytes) -> tuple[int, list[bytes], list[list[int]]]:
    """(m, seeds, rows of counters)."""
    m, k = struct.unpack_from(">II", data)
    cells = struct.unpack_from(f">{m * k}I", data, 8 + 32 * k)
    return m, [data[8 + 32 * i : 40 + 32 * i] for i in range(k)], [list(cells[m * i : m * i + m]) for i in range(k)]


def parse_token_bucket(data: bytes) -> tuple[int, int, int, int]:
    """(capacity, rate, tokens, last refill in nanoseconds)."""
    return (*struct.unpack_from(">QQQ", data), struct.unpack_from("<q", data, 24)[0])
