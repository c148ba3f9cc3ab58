import random
import re

import numpy as np
import xxhash

from keystrand.llm import simhash_dedup as sd
from keystrand.llm.queries import op9_simhash_near_dedup


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(values):
    found = list(range(len(values)))

    def root(i):
        while found[i] != i:
            found[i] = found[found[i]]
            i = found[i]
        return i

    array = np.array(values, dtype=np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= 3) + i + 1:
            found[root(i)] = root(int(j))
    return [root(i) for i in range(len(values))]


def check(rows, documents):
    values = [slow_fingerprint(t) for _, t in documents]
    roots, least = slow_components(values), {}
    for r, (d, _) in zip(roots, documents, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    key = lambda x: tuple(map(str, x))
    wanted = sorted(((d, f"{v:016x}", least.get(r)) for (d, _), v, r in zip(documents, values, roots, strict=True)), key=key)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=key) == wanted


def test_whole_table(spark):
    where = "/root/testdata/sf0.01"
    check(op9_simhash_near_dedup(spark, where).collect(), [tuple(r) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()])


def test_odd_rows(spark, store, odd_documents):
    rows, schema = odd_documents
    check(op9_simhash_near_dedup(spark, store(documents=(rows, schema))).collect(), [(r[0], r[1]) for r in rows])


def test_empty_table(spark, store, odd_documents):
    assert op9_simhash_near_dedup(spark, store(documents=([], odd_documents[1]))).count() == 0


def test_links_connect_what_brute_force_connects(spark):
    pick, values = random.Random(5), set()
    for _ in range(60):
        v = pick.getrandbits(64)
        for _ in range(12):
            values.add(v)
            for _ in range(pick.randint(1, 4)):
                v ^= 1 << pick.randrange(64)
    dense = pick.getrandbits(64)
    values |= {dense ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    values = sorted(values)
    distinct = spark.createDataFrame([(sd._signed(v),) for v in values], "fp long")
    roots = {r.node % 2**64: r.root for r in sd.components(sd.near_links(distinct, tile=16)).collect()}
    groups, wanted = {}, {}
    for v, r in zip(values, slow_components(values), strict=True):
        groups.setdefault(roots.get(v, v), set()).add(v)
        wanted.setdefault(r, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_a_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert sd.components(chain).select("root").distinct().count() == 1


def test_choices_cover_every_close_pair():
    for bits in [(a, b, c) for a in range(64) for b in range(a) for c in range(0, b, 5)]:
        assert any(not any(m >> k & 1 for k in bits) for m in sd.masks())
