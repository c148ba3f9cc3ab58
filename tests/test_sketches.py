import hashlib
import math
import struct
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keystrand.operators import bloom, cms, hll, instances, log, simhash
from keystrand.sources import legacy


def h64(data: bytes) -> int:
    return int.from_bytes(hashlib.md5(data).digest()[:8], "big")


def seeded(x: str, i: int) -> int:
    return h64(x.encode() + (1000 + i).to_bytes(4, "big") + bytes(28))


def elements(spark, values):
    return spark.createDataFrame([(v,) for v in values], "e string")


def slow_registers(values, p):
    out = {}
    for v in values:
        h = h64(v.encode())
        zeros = 64 if h == 0 else (h & -h).bit_length() - 1
        b = h >> (64 - p) if p else 0
        out[b] = max(out.get(b, 0), zeros + 1)
    return out


def slow_estimate(registers, p):
    m = 1 << p
    e = 0.7213 / (1 + 1.079 / m) * m * m / sum(2.0 ** -registers.get(b, 0) for b in range(m))
    empty = m - len(registers)
    if e <= 2.5 * m and empty:
        return m * math.log(m / empty)
    return -(2**32) * math.log(1 - e / 2**32) if e > 2**32 / 30 else e


@pytest.mark.parametrize("p", [0, 4, 10])
@pytest.mark.parametrize("n", [1, 15, 10_000])
def test_hll(spark, p, n):
    values = [f"v{i}" for i in range(n)]
    rows = hll.registers(elements(spark, [*values, *values[:5], None]), "e", p)
    assert {r.bucket: r["rank"] for r in rows.collect()} == slow_registers(values, p)
    assert hll.estimate(rows, p).first().estimate == pytest.approx(slow_estimate(slow_registers(values, p), p))


def test_hll_merge_payload_and_bounds(spark):
    a, b = ([f"v{i}" for i in r] for r in (range(60), range(40, 200)))
    merged = hll.merge(hll.registers(elements(spark, a), "e", 6), hll.registers(elements(spark, b), "e", 6))
    want = slow_registers({*a, *b}, 6)
    assert {r.bucket: r["rank"] for r in merged.collect()} == want
    payload = hll.payload(merged, 6)
    assert bytes(payload.first().payload) == struct.pack(">qB", 64, 6) + bytes(want.get(i, 0) for i in range(64))
    assert {r.bucket: r["rank"] for r in hll.registers_of_payload(payload).collect()} == want
    for p in (-1, 17):
        with pytest.raises(ValueError):
            hll.registers(elements(spark, a), "e", p)


def test_cms(spark):
    assert cms.checked(0.1, 0.1) == (28, 4) and cms.checked(1, 1) == (3, 1)
    values = [f"v{i % 37}" for i in range(900)] + ["once"]
    want = Counter((i, seeded(v, i) % 28) for v in values for i in range(4))
    cells = cms.cells(elements(spark, values), "e", 0.1, 0.1)
    assert {(r.row, r.col): r.n for r in cells.collect()} == want
    found = {r.e: r for r in cms.estimate(cells, elements(spark, ["v1", "once", "never"]), "e", 0.1, 0.1).collect()}
    for v, r in found.items():
        own = [want[i, seeded(v, i) % 28] for i in range(4)]
        assert (r.least, r.most) == (min(own), max(own)) and r.least >= values.count(v)
    halves = [cms.cells(elements(spark, values[k::2]), "e", 0.1, 0.1) for k in range(2)]
    assert {(r.row, r.col): r.n for r in cms.merge(*halves).collect()} == want
    for bad in ((0, 0.1), (0.1, 1.5)):
        with pytest.raises(ValueError):
            cms.checked(*bad)


def test_bloom(spark):
    assert bloom.sized(50, 0.01) == (480, 7)
    values, others = [f"v{i}" for i in range(50)], [f"w{i}" for i in range(500)]
    rows = bloom.bits(elements(spark, [*values, None]), "e", 480, 7)
    want = {seeded(v, i) % 480 for v in values for i in range(7)}
    assert {r.bit for r in rows.collect()} == want
    found = {r.e: r.maybe for r in bloom.membership(rows, elements(spark, [*values, *others]), "e", 480, 7).collect()}
    assert found == {v: all(seeded(v, i) % 480 in want for i in range(7)) for v in [*values, *others]}
    assert all(found[v] for v in values) and sum(found[w] for w in others) < 30
    parts = [bloom.bits(elements(spark, values[k::2]), "e", 480, 7) for k in range(2)]
    assert {r.bit for r in bloom.merge(*parts).collect()} == want
    for bad in ((0, 0.1), (5, 0), (5, 1)):
        with pytest.raises(ValueError):
            bloom.sized(*bad)


def slow_fingerprint(text):
    kept = [w for w in "".join(c for c in text if c not in simhash.PUNCTUATION).lower().split() if w not in simhash.STOP_WORDS]
    votes = [sum(2 * (h64(w.encode()) >> (63 - k) & 1) - 1 for w in kept) for k in range(64)]
    return sum(1 << (63 - k) for k in range(64) if votes[k] > 0)


def test_simhash(spark):
    texts = ["", "the and of", "...", "Well-known (words) words, words", "UPPER upper\tupper case", None, "ključ je tu"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(docs).collect()}
    assert got == {i: slow_fingerprint(t or "") for i, t in enumerate(texts)} and got[0] == got[1] == got[2] == 0
    assert {(r.doc_id, r.word): r.n for r in simhash.word_weights(docs).collect()}[3, "words"] == 3
    pairs = spark.createDataFrame([(3, 4), (0, 1), (0, 99)], "a long, b long")
    assert {(r.a, r.b): r.distance for r in simhash.distance_of(simhash.fingerprints(docs), pairs).collect()} == {(3, 4): (got[3] ^ got[4]).bit_count(), (0, 1): 0}


def test_near_duplicates_equal_brute_force(spark):
    import random

    pick, base = random.Random(1), [random.Random(2).getrandbits(64) for _ in range(8)]
    values = [b ^ sum(1 << pick.randrange(64) for _ in range(pick.randrange(5))) for b in base for _ in range(12)] + [base[0]] * 3
    prints = spark.createDataFrame([(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(v % 2**64 for v in values)], "doc_id long, fp long")
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    want = {(min(i, j), max(i, j), (v ^ w).bit_count()) for v, i in first.items() for w, j in first.items() if v != w and (v ^ w).bit_count() <= 3}
    assert {tuple(r) for r in simhash.near_duplicates(prints).collect()} == want
    assert {r.doc_id: r.representative for r in simhash.classes(prints).collect()} == {i: first[v] for i, v in enumerate(values)}


def test_payloads(spark):
    values = [f"v{i % 9}" for i in range(40)]
    m, k = bloom.sized(9, 0.1)
    seeds = [(1000 + i).to_bytes(4, "big") + bytes(28) for i in range(k)]
    data = bytes(bloom.payload(bloom.bits(elements(spark, values), "e", m, k), m, k).first().payload)
    assert legacy.parse_bloom(data) == (m, sorted({seeded(v, i) % m for v in values for i in range(k)}), seeds)
    want = Counter((i, seeded(v, i) % 6) for v in values for i in range(2))
    data = bytes(cms.payload(cms.cells(elements(spark, values), "e", 0.5, 0.9), 0.5, 0.9).first().payload)
    assert legacy.parse_cms(data) == (6, seeds[:2], [[want[i, c] for c in range(6)] for i in range(2)])


def test_instances(spark):
    at = datetime(2024, 1, 1)
    rows = log.as_log(spark.createDataFrame([("k", "v", at, 1, False)], "key string, value string, ts timestamp, seq long, dead boolean"), *map(F.col, ("key", "value", "ts", "seq", "dead")))
    sketch = hll.registers(elements(spark, ["a", "b"]), "e", 4)
    rows = instances.store(rows, "hll", "x", hll.payload(sketch, 4), at)
    back = hll.registers_of_payload(instances.fetch(rows, "hll", "x"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in sketch.collect()}
    assert log.live(rows).count() == 1
    rows = instances.drop(rows, "hll", "x", at)
    assert instances.fetch(rows, "hll", "x").count() == 0
    with pytest.raises(KeyError):
        instances.drop(rows, "hll", "x", at)
    for name, text in (("a", "one two three"), ("b", "one two four")):
        rows = instances.store_fingerprint(rows, name, text, at)
    assert instances.fingerprint_distance(rows, "a", "b") == (slow_fingerprint("one two three") ^ slow_fingerprint("one two four")).bit_count()
    with pytest.raises(KeyError):
        instances.fingerprint_distance(rows, "a", "zz")
    with pytest.raises(ValueError):
        instances.key_of("bloom", "")


def test_legacy_sketch_forms():
    seeds = [(1000 + i).to_bytes(4, "big") + bytes(28) for i in range(2)]
    assert legacy.parse_bloom(struct.pack(">I", 3) + b"\x01\x00\x01" + struct.pack(">I", 2) + b"".join(seeds)) == (3, [0, 2], seeds)
    assert legacy.parse_cms(struct.pack(">II", 2, 2) + b"".join(seeds) + struct.pack(">4I", 1, 2, 3, 4)) == (2, seeds, [[1, 2], [3, 4]])
    assert legacy.parse_token_bucket(struct.pack(">QQQ", 5, 1, 3) + struct.pack("<q", 77)) == (5, 1, 3, 77)
