"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors become integers, floor(``scale`` * x), and are dealt to groups of ascending ids.  A group's task cuts them into blocks of
at most ``BLOCK`` rows, halving along the direction in which they spread most, so that rows of a block are alike and its extremes
tight; each block has its forward index (its vectors) and the maximum and minimum of each component.  A query meets every group:
it orders the group's blocks by the sum over components of what a block's extremes allow, and scores them, ``AT_ONCE`` at a time,
until the bound of the next falls below its k-th score so far.  A bound that equals the k-th score may hide a tie of a smaller id,
so such a block is scored.  The groups' best meet per query.

Queries are rows of the same table that ``is_query`` names, so this is a search of a stated query set against all rows: groups are
streamed, and a task holds one group and one batch of queries.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id.  Vectors with components
of 2**53 or more are kept apart and scored in integers of any size, and ranked by them; only the score that is returned stops
at the limits of 64 bits.  Shorter vectors count as padded by zeros.  Rows that share the query's id are
its own and no candidates; a repeated query row is asked once.  Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrand.llm.common import as_binary

SCALE = 1024
TOP = 10
BLOCK = 32
#: Blocks that are scored in one product; those of a bound below the k-th score are left out of it.
AT_ONCE = 16
#: Queries that are bounded at a time.
BATCH = 256


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows (vec_id, body): the integers as little-endian signed 64-bit, without trailing zeros' meaning.

    A body with a component of 2**53 or more is a line of decimal numbers, of a length that is no multiple of 8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, bodies = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                own = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(own).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(own * scale)
                ids.append(i)
                bodies.append(x.astype("<i8").tobytes() if (np.abs(x) < 2.0**53).all() else large([math.floor(Fraction(c) * scale) for c in own.tolist()]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), as_binary(bodies)], names=["vec_id", "body"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, "vec_id long, body binary")


def large(numbers: list[int]) -> bytes:
    line = " ".join(map(str, numbers)).encode()
    return line + b" " * (1 + -len(line) % 8)


def is_large(body: bytes) -> bool:
    return len(body) % 8 != 0


def order_key(score: int) -> bytes | None:
    """Orders scores that the limits of 64 bits make equal."""
    if -(2**63) < score < 2**63 - 1:
        return None
    n = (score.bit_length() + 7) // 8
    key = n.to_bytes(4, "big") + abs(score).to_bytes(n, "big")
    return key if score > 0 else bytes(255 - x for x in key)


def matrix(bodies: list[bytes], width: int = 0) -> np.ndarray:
    if any(map(is_large, bodies)):
        rows = [list(map(int, b.split())) if is_large(b) else np.frombuffer(b, dtype="<i8").tolist() for b in bodies]
        width = max([width, *map(len, rows)])
        return np.array([r + [0] * (width - len(r)) for r in rows], dtype=object).reshape(len(rows), width)
    width = max([width, *(len(b) // 8 for b in bodies)])
    return np.frombuffer(b"".join(b.ljust(8 * width, b"\0") for b in bodies), dtype="<i8").reshape(len(bodies), width)


def halved(values: np.ndarray, size: int) -> list[np.ndarray]:
    """Indexes of the rows in parts of at most ``size``, each half of a part on one side along its direction of most spread."""
    waiting, parts = [np.arange(len(values))], []
    while waiting:
        own = waiting.pop()
        if len(own) <= size:
            parts.append(own)
            continue
        spread = values[own] - values[own].mean(axis=0)
        along = np.ones(values.shape[1])
        for _ in range(4):  # power iteration; the length of a direction is of no matter, but must stay finite
            along = spread.T @ (spread @ along)
            along /= np.abs(along).max(initial=0) or 1
        order = own[np.argsort(spread @ along, kind="stable")]
        waiting += [order[: len(order) // 2], order[len(order) // 2 :]]
    return parts


class Blocks:
    def __init__(self, ids: list[int], bodies: list[bytes], size: int = BLOCK):
        ids, self.values = np.array(ids, dtype=np.int64), matrix(bodies)
        self.largest = int(np.abs(self.values).max()) if self.values.size else 0
        double = self.values.dtype != object  # a larger number may be beyond a double, and is never bounded
        parts = halved(self.values.astype(np.float64), size) if double else [np.arange(c, min(c + size, len(ids))) for c in range(0, len(ids), size)]
        order, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
        self.ids, self.values = ids[order], self.values[order]
        self.starts, self.ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
        self.doubles = self.values.astype(np.float64) if double else None
        self.most = np.maximum.reduceat(self.doubles, self.starts, axis=0) if double else None
        self.least = np.minimum.reduceat(self.doubles, self.starts, axis=0) if double else None
        self.scored = self.met = 0  # blocks scored, of those that queries met

    def best(self, query_ids: list[int], bodies: list[bytes], top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, ids, scores) of each query's best rows here."""
        queries = matrix(bodies, self.values.shape[1])[:, : self.values.shape[1]]
        exact = self.most is not None and queries.dtype != object and self.largest * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) < 2**53
        wide = queries.astype(np.float64) if exact else queries
        bounds = np.maximum(wide, 0) @ self.most.T + np.minimum(wide, 0) @ self.least.T if exact else np.full((len(queries), len(self.starts)), np.inf)
        for k, own in enumerate(query_ids):
            ids, scores, floor = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64 if exact else object), None
            ranked = np.argsort(-bounds[k], kind="stable")
            self.met += len(ranked)
            for i in range(0, len(ranked), AT_ONCE):
                some = ranked[i : i + AT_ONCE]
                if floor is not None:
                    some = some[bounds[k, some] >= floor]
                    if not len(some):
                        break
                self.scored += len(some)
                rows = np.concatenate([np.arange(self.starts[j], self.ends[j]) for j in some])
                block_ids = self.ids[rows]
                found = (self.doubles[rows] @ wide[k]).astype(np.int64) if exact else self.values[rows].astype(object) @ queries[k].astype(object)
                good = block_ids != own
                if floor is not None:
                    good &= found >= floor
                if good.any():
                    ids, scores = np.concatenate([ids, block_ids[good]]), np.concatenate([scores, found[good]])
                    order = np.lexsort((ids, [-s for s in scores] if not exact else -scores))[:top]
                    ids, scores = ids[order], scores[order]
                    floor = scores[-1] if len(scores) == top else None
            yield k, ids, scores


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, scale: int = SCALE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score); ``is_query`` is a condition on ``vec_id``."""
    ready = quantised(vectors, id_col, vector_col, scale)
    n = vectors.count()
    rows = min(max(8_192, n // 1000), 1_000_000)
    n_groups = max(1, math.ceil(n / rows))
    cuts = vectors.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / n_groups for i in range(1, n_groups)], max(10_000, 20 * n_groups)).alias("q")).first()["q"] if n_groups > 1 else []
    edges = np.array(sorted(set(cuts or [])), dtype=np.int64)
    n_groups = len(edges) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = np.searchsorted(edges, b.column(0).to_numpy(), side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.zeros(len(b), dtype=bool)), *b.columns], names=["group", "asks", "vec_id", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, bodies, asking, blocks = None, [], [], [], None

        def parts() -> list[Blocks]:
            """The large vectors apart, so that the others' products stay within a double."""
            split = [[(i, x) for i, x in zip(ids, bodies, strict=True) if is_large(x) == big] for big in (False, True)]
            return [Blocks([i for i, _ in p], [x for _, x in p]) for p in split if p]

        def answer() -> pa.RecordBatch:
            q, v, s, t, o = [], [], [], [], []
            for own in ([a for a in asking if is_large(a[1]) == big] for big in (False, True)):
                for part in blocks if own else []:
                    for k, found, scores in part.best([a[0] for a in own], [a[1] for a in own], top):
                        q += [own[k][0]] * len(found)
                        t += [own[k][1]] * len(found)
                        v += found.tolist()
                        s += [max(-(2**63), min(2**63 - 1, int(x))) for x in scores]
                        o += [order_key(int(x)) for x in scores]
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), as_binary(t), pa.array(v, pa.int64()), pa.array(s, pa.int64()), as_binary(o)], names=["query_id", "query", "vec_id", "score", "key"])

        for b in batches:
            for group, asks, i, body in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if group != current:
                    if asking and blocks:
                        yield answer()
                    current, ids, bodies, asking, blocks = group, [], [], [], None
                if not asks:
                    ids.append(i)
                    bodies.append(body)
                    continue
                if blocks is None and ids:
                    blocks, ids, bodies = parts(), [], []
                if blocks:
                    asking.append((i, body))
                    if len(asking) == BATCH:
                        yield answer()
                        asking = []
        if asking and blocks:
            yield answer()

    queries = ready.where(is_query).distinct()
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("group"), F.lit(True).alias("asks"), "vec_id", "body")
    dealt = ready.mapInArrow(deal, "group int, asks boolean, vec_id long, body binary").unionByName(asked)
    found = dealt.repartitionById(n_groups, F.col("group")).sortWithinPartitions("group", "asks", "vec_id").mapInArrow(run, "query_id long, query binary, vec_id long, score long, key binary")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.desc("key"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
