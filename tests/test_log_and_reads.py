from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keystrand.operators import compaction, log, read
from keystrand.plans.numbering import numbered
from keystrand.sources import generators

BASE = datetime(2024, 1, 1)


def make(spark, rows):
    """rows: (key, value, second, seq, tombstone)."""
    df = spark.createDataFrame([(k, v, BASE + timedelta(seconds=t), s, d) for k, v, t, s, d in rows], "key string, value string, ts timestamp, seq long, dead boolean")
    return log.as_log(df, F.col("key"), F.col("value"), F.col("ts"), F.col("seq"), F.col("dead"))


def state(df):
    return {r.key: bytes(r.value).decode() for r in df.collect()}


@pytest.mark.parametrize(("make_load", "keys"), [(generators.load_100, range(1, 101)), (generators.load_5000, range(1, 5001)), (generators.load_500, range(500))])
def test_load_generators(spark, make_load, keys):
    found = log.live(make_load(spark)).select("key", F.col("value").cast("string").alias("v")).collect()
    assert {r.v for r in found} == {"TEST"} and sorted(int(r.key) for r in found) == list(keys)


def test_newest_decides(spark):
    rows = [("a", "1", 0, 1, False), ("a", "2", 0, 2, False), ("b", "1", 5, 3, False), ("b", None, 6, 4, True), ("c", "1", 1, 5, False), ("c", None, 2, 6, True), ("c", "3", 3, 7, False), ("d", "old", 9, 8, False), ("d", "late", 1, 9, False)]
    assert state(log.live(make(spark, rows))) == {"a": "2", "c": "3", "d": "old"}


def test_corrupt_rows_do_not_win(spark):
    rows = make(spark, [("a", "1", 0, 1, False), ("a", "2", 1, 2, False)])
    broken = rows.withColumn("crc", F.when(F.col("seq") == 2, F.col("crc") + 1).otherwise(F.col("crc")))
    assert state(log.live(log.valid(broken))) == {"a": "1"}


def test_put_and_delete(spark):
    rows = make(spark, [("a", "1", 0, 1, False)])
    new = spark.createDataFrame([("b", "2", BASE + timedelta(seconds=9))], "key string, value string, ts timestamp")
    rows = log.put(rows, new)
    gone = spark.createDataFrame([("a", BASE + timedelta(seconds=10))], "key string, ts timestamp")
    assert state(log.live(log.delete(rows, gone, strict=True))) == {"b": "2"}
    absent = spark.createDataFrame([("zz", BASE)], "key string, ts timestamp")
    assert state(log.live(log.delete(rows, absent))) == {"a": "1", "b": "2"}
    with pytest.raises(KeyError):
        log.delete(rows, absent, strict=True)
    for key in ("", "tb_x", None):
        with pytest.raises(ValueError):
            log.put(rows, spark.createDataFrame([(key, "v", BASE)], "key string, value string, ts timestamp"))


def test_reserved_keys_are_hidden_unless_asked_for(spark):
    rows = make(spark, [(k, "v", 0, i, False) for i, k in enumerate(["bf_x", "cms_x", "hll_x", "sh_x", "user", "bfx"])])
    assert set(state(log.live(rows))) == {"user", "bfx"} and len(state(log.live(rows, include_reserved=True))) == 6
    assert read.get(rows, "bf_x").count() == 0 and read.get(rows, "bf_x", include_reserved=True).count() == 1


def test_pages_make_the_whole_scan(spark):
    rows = make(spark, [(f"k{i:02d}", "v", 0, i, i == 3) for i in range(26)])
    found = read.prefix_scan(rows, "K")
    pages = [[r.key for r in read.page(found, n, 10).collect()] for n in range(1, 5)]
    assert [len(p) for p in pages] == [10, 10, 5, 0] and sum(pages, []) == sorted(r.key for r in found.collect())
    assert [r.key for r in read.iterate(found)] == sum(pages, [])
    assert [[r.key for r in b] for b in read.iterate_steps(found, 10)] == pages[:3]
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            read.page(found, *bad)


def test_range_and_points(spark):
    rows = make(spark, [(k, k, 0, i, False) for i, k in enumerate(["10", "2", "1", "Ab", "aC"])])
    assert [r.key for r in read.range_scan(rows, "1", "2").orderBy("key").collect()] == ["1", "10", "2"]
    assert state(read.get(rows, "10")) == {"10": "10"} and read.get(rows, "11").count() == 0
    asked = spark.createDataFrame([("2",), ("nope",), ("2",)], "key string")
    assert sorted((r.key, r.seq) for r in read.multi_get(rows, asked).collect()) == [("2", 1), ("nope", None)]


def test_key_filter_reaches_the_scan(spark, tmp_path):
    make(spark, [(str(i), "v", 0, i, False) for i in range(50)]).write.parquet(str(tmp_path / "log"))
    plan = read.get(spark.read.parquet(str(tmp_path / "log")), "7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,7)" in plan and "EqualTo(tombstone" not in plan


def test_dictionary(spark):
    rows = make(spark, [(k, "v", 0, i, False) for i, k in enumerate("cabca")])
    ids = log.dictionary(rows)
    assert {r.key: r.id for r in ids.collect()} == {"c": 0, "a": 1, "b": 2}
    assert {r.key: r.id for r in log.dictionary_of_json(log.dictionary_json(ids)).collect()} == {"c": 0, "a": 1, "b": 2}
    back = log.decode_keys(log.encode_keys(rows, ids), ids)
    assert sorted((r.seq, r.key) for r in back.collect()) == sorted((r.seq, r.key) for r in rows.collect())


def test_merging_runs_changes_nothing(spark):
    rows = generators.load(spark, 3000, 40).withColumn("tombstone", F.col("seq") % 7 == 0)
    rows = log.as_log(rows, F.col("key"), F.col("value"), F.col("ts"), F.col("seq"), F.col("tombstone"))
    whole = {(r.key, r.seq) for r in log.live(rows).collect()}
    for n in (1, 3):
        parts = [compaction.merged(rows.where(F.col("seq") % n == k), drop_tombstones=False) for k in range(n)]
        for order in (parts, parts[::-1]):
            both = order[0]
            for p in order[1:]:
                both = both.unionByName(p)
            assert {(r.key, r.seq) for r in compaction.merged(both, drop_tombstones=True).collect()} == whole


def test_numbering(spark):
    rows = spark.createDataFrame([(i * 37 % 101, "x") for i in range(101)], "k int, v string").repartition(7)
    assert sorted((r.k, r.n) for r in numbered(rows, ["k"], "n", 5).collect()) == [(i, i + 5) for i in range(101)]
    assert numbered(rows.limit(0), ["k"], "n").count() == 0
