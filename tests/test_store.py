from pyspark.sql import functions as F

from keystrand.config import Settings
from keystrand.operators import bloom, cms, hll
from keystrand.operators.store import Store
from keystrand.plans.numbering import numbered


def keyed(spark, pairs, second):
    return spark.createDataFrame(pairs, "key string, value string").withColumn("ts", F.timestamp_seconds(F.lit(second)))


def test_store_is_one_log_over_runs_and_late_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", Settings(MaxSize=3, NumberOfMemtables=1, CacheMaxSize=1))
    store.put(keyed(spark, [("Ab", "1"), ("aC", "2")], 1))
    assert store.batches() == [0] and store.runs.manifest() == []
    store.put(keyed(spark, [("b", "3")], 2))
    assert store.batches() == [] and len(store.runs.manifest()) == 1
    store.delete(keyed(spark, [("Ab", "")], 3).drop("value"), strict=True)
    assert store.lookup("Ab") is None and bytes(store.lookup("b")["value"]) == b"3" and list(store.cached) == ["b"]
    assert {r.key for r in store.prefix_scan("A").collect()} == {"aC"} and {r.key for r in store.range_scan("A", "B").collect()} == {"aC", "b"}
    again = Store(spark, f"file://{tmp_path}/s")
    assert again.settings == store.settings and {r.key for r in again.live().collect()} == {"aC", "b"}
    assert [r.value for r in again.multi_get(keyed(spark, [("Ab", "")], 0)).collect()] == [None]


def test_flush_of_an_empty_log_does_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.flush() == 0 and store.live().count() == 0


def test_the_other_name_of_levelled_compaction_is_read():
    assert Settings.from_json('{"CompactType": "level"}').CompactType == "level"


def test_stored_counters_stop_at_four_bytes(spark):
    m, k = cms.checked(0.5, 0.5)
    cells = spark.createDataFrame([(0, 0, 2**32), (0, 1, 2**32 - 1), (1, 2, 7)], "row int, col int, n long")
    stored = cms.payload(cells, 0.5, 0.5)
    assert {(r.row, r.col, r.n) for r in cms.cells_of_payload(stored, m, k).collect()} == {(0, 0, 2**32 - 1), (0, 1, 2**32 - 1), (1, 2, 7)}


def test_payloads_are_read_back(spark):
    words = spark.createDataFrame([(f"w{i}",) for i in range(40)], "e string")
    m, size = bloom.sized(50, 0.01)
    bits = bloom.bits(words, "e", m, size)
    stored = bloom.payload(bits, m, size)
    assert bloom.parameters(bytes(stored.first()["payload"])) == (m, size, bloom.SEED)
    assert {r.bit for r in bloom.bits_of_payload(stored, m).collect()} == {r.bit for r in bits.collect()}
    registers = hll.registers(words, "e", 4)
    assert sorted(hll.registers_of_payload(hll.payload(registers, 4)).collect()) == sorted(registers.collect())


def test_numbers_with_odd_column_names(spark):
    rows = spark.createDataFrame([(2, 1, 1), (1, 5, 5)], "`a.b` int, at int, `range` int")
    assert sorted(tuple(r) for r in numbered(rows, ["a.b"], "place").collect()) == [(1, 5, 5, 0), (2, 1, 1, 1)]
