import zlib
import struct
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keystrand.config import Settings
from keystrand.functions import hashing, keys


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_unsigned_modulo(spark):
    values = [0, 1, -1, -(2**63), 2**63 - 1, 123456789, -987654321]
    rows = spark.createDataFrame([(v,) for v in values], "h long").select("h", *[hashing.unsigned_mod(F.col("h"), m).alias(f"m{m}") for m in (1, 2, 7, 28, 479, 95851)])
    for r in rows.collect():
        assert list(r)[1:] == [(r.h % 2**64) % m for m in (1, 2, 7, 28, 479, 95851)]


def test_bits(spark):
    values = [0, 1, 2, 8, -1, -(2**63), 96]
    rows = spark.createDataFrame([(v,) for v in values], "h long")
    zeros = [r[0] for r in rows.select(hashing.trailing_zeros(F.col("h"))).collect()]
    assert zeros == [64 if v == 0 else ((v & -v).bit_length() - 1) for v in values]
    assert [r[0] for r in rows.select(hashing.top_bits(F.col("h"), 4)).collect()] == [(v % 2**64) >> 60 for v in values]
    assert {r[0] for r in rows.select(hashing.top_bits(F.col("h"), 0)).collect()} == {0}
    assert [r[0] for r in rows.select(hashing.unpack64(hashing.pack64("h"))).collect()] == values
    assert one(spark, hashing.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")))[0] == 64


def test_record_crc_equals_zlib(spark):
    rows = [("ključ", b"TEST", datetime(2024, 1, 2, 3, 4, 5), False), ("k", None, datetime(1999, 1, 1), True), ("", b"", datetime(1970, 1, 1), False)]
    got = [r[0] for r in spark.createDataFrame(rows, "key string, value binary, ts timestamp_ntz, tombstone boolean").select(hashing.record_crc()).collect()]
    for crc, (k, v, ts, dead) in zip(got, rows, strict=True):
        k, v = k.encode(), v or b""
        seconds = int((ts - datetime(1970, 1, 1)).total_seconds())
        assert crc == zlib.crc32(struct.pack(">q?qq", seconds, dead, len(k), len(v)) + k + v)


def test_key_predicates(spark):
    rows = spark.createDataFrame([(k,) for k in ["Ab", "aB", "AC", "b", "bf_x", "shx", "tb_", "ščž"]], "key string")
    pick = lambda c: [r.key for r in rows.where(c).orderBy("key").collect()]
    assert pick(keys.has_prefix("a")) == ["AC", "Ab", "aB"]
    assert pick(keys.has_prefix("a", case_sensitive=True)) == ["aB"]
    assert pick(keys.in_range("AB", "b")) == ["AC", "Ab", "aB", "b"]
    assert pick(keys.in_range("AB", "b", case_sensitive=True)) == ["AC", "Ab", "aB", "b"]
    assert pick(keys.is_reserved()) == ["bf_x", "tb_"]
    assert [r[0] for r in rows.where("key = 'bf_x'").select(keys.kind()).collect()] == ["bloom"]
    assert rows.where("key = 'AC'").select(keys.key_head("key", 1)).first()[0] == "a"


@given(st.sampled_from(["MaxTables", "Capacity", "IndexInterval", "M"]), st.integers(max_value=0))
def test_settings_refuse_what_is_not_positive(name, value):
    with pytest.raises(ValueError, match=name):
        Settings(**{name: value})


def test_settings_round_trip():
    s = Settings(CompactBy="amount", Compress=True)
    assert Settings.from_json(s.to_json()) == s and len(s.to_json().splitlines()) == 20
    for bad in ('{"Nope": 1}', '{"CompactType": "x"}', '{"Compress": 1}'):
        with pytest.raises(ValueError):
            Settings.from_json(bad)
