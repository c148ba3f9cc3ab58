"""Named sketches and fingerprints, kept in the log under reserved keys.

An instance is a put of its serialised form under prefix and name; deleting it is a tombstone like any other.  A sketch is
built from a column in one aggregation and stored once, and grows by merging, so no element costs a copy of the sketch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.functions.hashing import hamming, pack64, unpack64
from keystrand.functions.keys import RESERVED
from keystrand.operators import bloom, cms, hll, log, read
from keystrand.operators.simhash import fingerprints

PREFIX = {kind: prefix for prefix, kind in RESERVED.items() if kind != "token_bucket"}


def key_of(kind: str, name: str) -> str:
    if not name:
        raise ValueError("an instance needs a name")
    return PREFIX[kind] + name


def store(rows: DataFrame, kind: str, name: str, payload: DataFrame, ts) -> DataFrame:
    """The log with an instance put: ``payload`` has one row (payload)."""
    return log.put(rows, payload.select(F.lit(key_of(kind, name)).alias("key"), F.col("payload").alias("value"), F.lit(ts).alias("ts")))


def fetch(rows: DataFrame, kind: str, name: str) -> DataFrame:
    """The instance's row (payload), or none."""
    return read.get(rows, key_of(kind, name), include_reserved=True).select(F.col("value").alias("payload"))


def drop(rows: DataFrame, kind: str, name: str, ts) -> DataFrame:
    gone = rows.sparkSession.range(1).select(F.lit(key_of(kind, name)).alias("key"), F.lit(ts).alias("ts"))
    return log.delete(rows, gone, strict=True)


def store_fingerprint(rows: DataFrame, name: str, text: str, ts) -> DataFrame:
    one = rows.sparkSession.range(1).select(F.lit(0).alias("doc_id"), F.lit(text).alias("text"))
    return store(rows, "simhash", name, fingerprints(one).select(pack64("fp").alias("payload")), ts)


def fingerprint_distance(rows: DataFrame, a: str, b: str) -> int:
    """Hamming distance of two stored fingerprints."""
    pair = [fetch(rows, "simhash", n).select(unpack64("payload").alias("fp")).first() for n in (a, b)]
    if None in pair:
        raise KeyError("no such fingerprint")
    one = rows.sparkSession.range(1)
    return one.select(hamming(F.lit(pair[0]["fp"]), F.lit(pair[1]["fp"])).alias("d")).first()["d"]


def _stored(rows: DataFrame, kind: str, name: str) -> tuple[DataFrame, bytes]:
    """(the instance's row, its bytes); raises if there is none."""
    found = fetch(rows, kind, name)
    if (one := found.first()) is None:
        raise KeyError(f"no such instance: {name}")
    return found, bytes(one["payload"])


def bloom_add(rows: DataFrame, name: str, items: DataFrame, element: str, ts) -> DataFrame:
    """The log with a stored filter that also has the items' elements."""
    found, data = _stored(rows, "bloom", name)
    m, k, seed = bloom.parameters(data)
    grown = bloom.merge(bloom.bits_of_payload(found, m), bloom.bits(items, element, m, k, seed))
    return store(rows, "bloom", name, bloom.payload(grown, m, k, seed), ts)


def bloom_check(rows: DataFrame, name: str, items: DataFrame, element: str) -> DataFrame:
    """Rows (element, maybe) by a stored filter."""
    found, data = _stored(rows, "bloom", name)
    m, k, seed = bloom.parameters(data)
    return bloom.membership(bloom.bits_of_payload(found, m), items, element, m, k, seed)


def cms_add(rows: DataFrame, name: str, items: DataFrame, element: str, ts) -> DataFrame:
    """The log with a stored sketch that also counts the items."""
    found, data = _stored(rows, "cms", name)
    m, k, seed = cms.parameters(data)
    grown = cms.merge(cms.cells_of_payload(found, m, k), cms.cells_of(items, element, m, k, seed))
    return store(rows, "cms", name, cms.payload_of(grown, m, k, seed), ts)


def cms_frequency(rows: DataFrame, name: str, items: DataFrame, element: str) -> DataFrame:
    """Rows (element, least, most) by a stored sketch."""
    found, data = _stored(rows, "cms", name)
    m, k, seed = cms.parameters(data)
    return cms.estimate_of(cms.cells_of_payload(found, m, k), items, element, m, k, seed)


def hll_add(rows: DataFrame, name: str, items: DataFrame, element: str, ts) -> DataFrame:
    """The log with a stored sketch that also has the items' elements."""
    found, data = _stored(rows, "hll", name)
    grown = hll.merge(hll.registers_of_payload(found), hll.registers(items, element, data[8]))
    return store(rows, "hll", name, hll.payload(grown, data[8]), ts)


def hll_cardinality(rows: DataFrame, name: str) -> DataFrame:
    """One row (estimate) by a stored sketch."""
    found, data = _stored(rows, "hll", name)
    return hll.estimate(hll.registers_of_payload(found), data[8])
