import struct
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from keystrand.operators import cms, hll, log, token_bucket
from keystrand.streaming import admission, ingest

BASE = datetime(2024, 1, 1)


def events(spark, n=200):
    rows = [(i, str(i * 7 % 11), f"v{i}", BASE + timedelta(seconds=i * i % 97), i % 5 == 0) for i in range(n)]
    df = spark.createDataFrame(rows, "seq long, key string, value string, ts timestamp, dead boolean")
    return log.as_log(df, F.col("key"), F.col("value"), F.col("ts"), F.col("seq"), F.col("dead"))


def slow_bucket(rows, capacity, rate, unit):
    out, state = {}, {}
    for seq, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        tokens, last = state.get(key, (capacity, ts))
        more = int((ts - last).total_seconds() // unit) * rate
        if more > 0:
            tokens, last = min(capacity, tokens + more), ts
        out[seq] = tokens > 0
        state[key] = (max(0, tokens - 1), last)
    return out


def test_streams_equal_batches(spark, tmp_path):
    rows = events(spark)
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = ingest.source(spark, str(tmp_path / "in"), files_a_batch=1)
    ingest.upsert(stream, str(tmp_path / "up"), str(tmp_path / "c1")).awaitTermination()
    ingest.ingest(stream, str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination()
    ingest.hll_sketch(stream, "value", 5, str(tmp_path / "hll"), str(tmp_path / "c3")).awaitTermination()
    ingest.cms_sketch(stream, "key", 0.1, 0.1, str(tmp_path / "cms"), str(tmp_path / "c4")).awaitTermination()
    as_set = lambda df: {tuple(map(str, r)) for r in df.collect()}
    assert as_set(ingest.upserted(spark, str(tmp_path / "up")).select("key", "seq")) == as_set(log.latest(rows).select("key", "seq"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 200
    assert as_set(ingest.hll_registers(spark, str(tmp_path / "hll"))) == as_set(hll.registers(rows, "value", 5))
    assert as_set(ingest.cms_cells(spark, str(tmp_path / "cms"))) == as_set(cms.cells(rows, "key", 0.1, 0.1))
    assert ingest.truncate(spark, str(tmp_path / "log"), 2) == 2 and 0 < spark.read.parquet(str(tmp_path / "log")).count() < 200
    # A restart finds nothing new and changes nothing.
    ingest.upsert(stream, str(tmp_path / "up"), str(tmp_path / "c1")).awaitTermination()
    assert ingest.upserted(spark, str(tmp_path / "up")).count() == 11


def test_token_bucket(spark):
    rows = events(spark)
    plain = [(r.seq, r.key, r.ts) for r in rows.collect()]
    for capacity, rate, unit in ((3, 1, 10), (1, 2, 1), (5, 1, 1000)):
        got = {r.seq: r.admitted for r in token_bucket.admit(rows, capacity, rate, unit).collect()}
        assert got == slow_bucket(plain, capacity, rate, unit)


def test_token_bucket_payload(spark):
    df = spark.createDataFrame([(5, 1, 3, 1_700_000_000_123_456_789)], "c long, r long, t long, n long")
    assert bytes(df.select(token_bucket.payload("c", "r", "t", "n")).first()[0]) == struct.pack(">QQQ", 5, 1, 3) + struct.pack("<q", 1_700_000_000_123_456_789)


def test_admission_stream(spark, tmp_path):
    rows = events(spark, 60)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = admission.admit_stream(ingest.source(spark, str(tmp_path / "in")), 3, 1, 10)
    query = found.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.seq: r.admitted for r in spark.sql("select * from admitted").collect()}
    assert got == slow_bucket([(r.seq, r.key, r.ts) for r in rows.collect()], 3, 1, 10)
