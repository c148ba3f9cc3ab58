import math
import random

import numpy as np

from keystrand.llm import topk
from keystrand.llm.queries import op4_exact_top_k

SCHEMA = "vec_id long, embedding array<float>, label int, body string, `group` int"


def slow(rows, step=100, top=10):
    good = []
    for r in rows:
        i, v = r[0], r[1]
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, tuple(math.floor(1024 * x) for x in v)))
    out = []
    for q, a in {g for g in good if g[0] % step == 0}:
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:top]
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    return sorted(out)


def test_whole_table(spark):
    where = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{where}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(map(tuple, op4_exact_top_k(spark, where).collect())) == slow(rows)


def test_odd_rows(spark, store):
    pick = random.Random(2)
    rows = [(i * 10, [pick.choice([-0.5, 0.0, 0.25]) for _ in range(4)], 1, "b", 2) for i in range(60)]
    rows += [(1, None, 1, "b", 2), (2, [None, 1.0], 1, "b", 2), (3, [float("nan")] * 4, 1, "b", 2), (4, [float("inf")] * 4, 1, "b", 2), (None, [1.0] * 4, 1, "b", 2), (200, [], None, None, None), rows[10], rows[11], (7, [0.25] * 6, 1, "b", 2)]
    found = sorted(map(tuple, op4_exact_top_k(spark, store(embeddings=(rows, SCHEMA))).collect()))
    assert found == slow(rows)


def test_few_rows_and_empty_table(spark):
    rows = [(0, [1.0, 2.0]), (5, [0.5, 0.5])]
    make = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<float>")
    asked = topk.F.col("vec_id") % 100 == 0
    assert [tuple(r) for r in topk.top_k(make(rows), asked).collect()] == [(0, 1, 5, 1024 * 512 + 2048 * 512)]
    assert topk.top_k(make([]), asked).count() == 0


def test_pruning_and_big_numbers():
    pick = random.Random(4)
    for scale in (3, 2**40):
        rows = [(i, [pick.randrange(-scale, scale) for _ in range(3)]) for i in range(500)]
        blocks = topk.Blocks([i for i, _ in rows], [topk.np.array(v, dtype="<i8").tobytes() for _, v in rows], size=16)
        asked = rows[::50]
        for k, ids, scores in blocks.best([i for i, _ in asked], [topk.np.array(v, dtype="<i8").tobytes() for _, v in asked], 10):
            best = sorted((-sum(x * y for x, y in zip(asked[k][1], v, strict=True)), i) for i, v in rows if i != asked[k][0])[:10]
            assert [(-s, i) for i, s in zip(ids.tolist(), map(int, scores), strict=True)] == best


def test_large_components_take_part(spark):
    pick = random.Random(8)
    rows = [(i, [pick.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(0, 300, 5)]
    rows += [(1, [1e13, 0.0, 1.0]), (2, [-1e13, 1.0]), (3, [3e38, -3e38, 1e20]), (4, [1e38, 0.0, 0.0]), (6, [2e38]), (7, [1e308, 1.5, -1e308]), (400, [9e12, 1.0, -1.0]), (500, [-1e30, 2.0, 1e300])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(map(tuple, topk.top_k(docs, topk.F.col("vec_id") % 100 == 0).collect()))
    exact = [(i, [math.floor(1024 * topk.Fraction(x)) for x in v]) for i, v in rows]
    want = []
    for q, a in exact:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in exact if i != q)[:10]
            want += [(q, k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best)]
    assert found == sorted(want) and {r[2] for r in found} >= {3, 4, 6, 7}


def test_blocks_are_pruned_where_vectors_cluster():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 400
    values = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 20).astype("<i8")
    blocks = topk.Blocks(list(range(4000)), [v.tobytes() for v in values])
    found = list(blocks.best(list(range(0, 4000, 100)), [values[i].tobytes() for i in range(0, 4000, 100)], 10))
    for k, ids, scores in found:
        own = values @ values[100 * k]
        order = [i for i in np.lexsort((np.arange(4000), -own)) if i != 100 * k][:10]
        assert ids.tolist() == order and scores.tolist() == own[order].tolist()
    assert blocks.scored < 0.5 * blocks.met
