import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keystrand.config import Settings
from keystrand.operators import compaction, log, merkle
from keystrand.sources import legacy
from keystrand.sources.runs import RunStore

BASE = datetime(2024, 1, 1)


def slow_tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([hashlib.sha1(bytes.fromhex(row[i] + (row[i + 1] if i + 1 < len(row) else row[i]))).hexdigest() for i in range(0, len(row), 2)])
    return levels


@pytest.mark.parametrize("n", [1, 2, 3, 5, 25])
def test_merkle(spark, n):
    df = spark.createDataFrame([(i, f"row {i}") for i in range(n)], "k int, v string")
    whole = merkle.tree(merkle.leaves(df, F.sha1("v"), ["k"]))
    want = slow_tree([hashlib.sha1(f"row {i}".encode()).hexdigest() for i in range(n)])
    assert {(r.level, r.idx): r.digest for r in whole.collect()} == {(k, i): d for k, row in enumerate(want) for i, d in enumerate(row)}
    assert merkle.roots(whole).first().root == want[-1][0]
    changed = merkle.tree(merkle.leaves(df.withColumn("v", F.when(F.col("k") == n - 1, F.lit("x")).otherwise(F.col("v"))), F.sha1("v"), ["k"]))
    assert merkle.diff(whole, changed).count() == len(want) and merkle.diff(whole, whole).count() == 0


def test_merkle_serialised_in_pre_order(spark):
    df = spark.createDataFrame([(i,) for i in range(4)], "k int")
    want = slow_tree([hashlib.sha1(str(i).encode()).hexdigest() for i in range(4)])
    (a, b, c, d), (ab, cd), (root,) = want
    text = merkle.serialised(merkle.tree(merkle.leaves(df, F.sha1(F.col("k").cast("string")), ["k"]))).first().text
    assert text == "|".join([root, ab, a, b, cd, c, d])
    assert merkle.parsed(text, 4) == [(0, 0, a), (0, 1, b), (0, 2, c), (0, 3, d), (1, 0, ab), (1, 1, cd), (2, 0, root)]
    with pytest.raises(ValueError):
        merkle.parsed(text, 5)


@pytest.mark.parametrize("n", [1, 3, 5])
def test_merkle_parse_is_the_inverse(spark, n):
    whole = merkle.tree(merkle.leaves(spark.createDataFrame([(i,) for i in range(n)], "k int"), F.sha1(F.col("k").cast("string")), ["k"]))
    text = merkle.serialised(whole).first().text
    assert merkle.parsed(text, n) == sorted((r.level, r.idx, r.digest) for r in whole.collect())


def rows_of(spark, rows):
    df = spark.createDataFrame([(k, v, BASE + timedelta(seconds=s), s, v is None) for k, v, s in rows], "key string, value string, ts timestamp, seq long, dead boolean")
    return log.as_log(df, F.col("key"), F.col("value"), F.col("ts"), F.col("seq"), F.col("dead"))


@pytest.mark.parametrize("settings", [Settings(MaxBytesSSTables=1), Settings(CompactBy="amount", MaxTables=1), Settings(MaxBytesSSTables=1, CompactType="leveled")])
def test_compaction_keeps_the_state(spark, tmp_path, settings):
    store = RunStore(spark, str(tmp_path / "runs"))
    assert store.read().count() == 0
    seq = iter(range(1, 1000))
    for n in range(5):
        store.add(rows_of(spark, [(f"k{(n * 3 + i) % 9}", None if (n + i) % 4 == 0 else f"v{n}", next(seq)) for i in range(6)]))
        before = {(r.key, r.seq) for r in log.live(store.read().select(*log.COLUMNS)).collect()}
        merges = compaction.compact(store, settings)
        after = {(r.key, r.seq) for r in log.live(store.read().select(*log.COLUMNS)).collect()}
        assert after == before and (merges > 0) == (n > 0 and len([r for r in store.manifest() if r["level"] == 1]) == 0)
    assert any(r["level"] > 1 for r in store.manifest())


def test_tombstones_go_only_at_the_deepest_level(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    store.add(rows_of(spark, [("a", "old", 1), ("b", "old", 2)]), level=3)
    store.add(rows_of(spark, [("a", None, 3)]))
    store.add(rows_of(spark, [("c", "x", 4)]))
    assert compaction.size_tiered(store, Settings(MaxBytesSSTables=1, NumberOfLevels=2)) == 1
    assert {r.key for r in log.live(store.read().select(*log.COLUMNS)).collect()} == {"b", "c"}
    assert store.read().where("key = 'a' and tombstone").count() == 1


def test_altered_runs_are_found(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    for n in range(2):
        store.add(rows_of(spark, [(f"k{i}", f"v{n}", i + n * 10) for i in range(5)]))
    known = merkle.roots(store.tree()).select("run_id", "root").collect()
    known = spark.createDataFrame(known, "run_id int, root string")
    assert store.altered(known).count() == 0
    runs = store.manifest()
    rows_of(spark, [("k9", "other", 99)]).withColumn("key_lc", F.lower("key")).write.mode("append").parquet(runs[1]["path"])
    assert [r.run_id for r in store.altered(known).collect()] == [runs[1]["run_id"]]


def test_legacy_log_cut_into_segments(spark, tmp_path):
    records = [(f"k{i}".encode(), b"TEST" * i, 1_700_000_000 + i, i % 3 == 0) for i in range(30)]
    data = bytearray(b"".join(legacy.log_record(*r) for r in records))
    bad = len(b"".join(legacy.log_record(*r) for r in records[:7])) + 30
    data[bad] ^= 1
    for k in range(0, len(data), 512):
        (tmp_path / f"wal_{k // 512:03d}.log").write_bytes(data[k : k + 512])
    got = sorted((r.ts, r.key, bytes(r.value), r.tombstone) for r in legacy.read_log(spark, str(tmp_path)).collect())
    assert got == [(t, k.decode(), v, d) for i, (k, v, t, d) in enumerate(records) if i != 7]


@pytest.mark.parametrize("compressed", [False, True])
def test_legacy_tables(spark, tmp_path, compressed):
    names = {i: f"key{i}" for i in range(6)}
    records = [(names[i].encode(), b"" if i == 2 else b"v%d" % i, 1_700_000_000 + i, i == 2) for i in range(6)]
    (tmp_path / "lvl_1_sstable_data_1.db").write_bytes(b"".join(legacy.table_record(*r, key_id=i if compressed else None) for i, r in enumerate(records)))
    found = legacy.read_tables(spark, str(tmp_path), json.dumps(names) if compressed else None)
    assert sorted((r.key, bytes(r.value), r.ts, r.tombstone) for r in found.collect()) == [(k.decode(), v, t, d) for k, v, t, d in records]
