"""Merkle trees of runs: digests as rows (run_id, level, idx, digest), level 0 the leaves.

A parent is SHA-1 over its children's digests; an odd node is paired with itself.  The levels of all runs are built together,
some levels by one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.plans.numbering import numbered
from keystrand.plans.storage import written


#: Levels that are made in one job.
HEIGHT = 8


def leaves(rows: DataFrame, digest: Column, order: list[str], run_id: Column | None = None) -> DataFrame:
    """Leaves in the order of keys within a run, of a run of any size: all rows are numbered by ranges, and each run starts at 0."""
    named = rows.select(*order, (F.lit(0) if run_id is None else run_id).alias("run_id"), digest.alias("digest"))
    placed = numbered(named, ["run_id", *order], "place")
    starts = placed.groupBy("run_id").agg(F.min("place").alias("start"))
    idx = (F.col("place") - F.col("start")).cast("long")
    return placed.join(starts, "run_id").select("run_id", F.lit(0).alias("level"), idx.alias("idx"), "digest")


def parent_in(nodes: Column):
    return lambda j: F.sha1(F.unhex(F.concat(F.get(nodes, j * 2), F.coalesce(F.get(nodes, j * 2 + 1), F.get(nodes, j * 2)))))


def parents(level: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Rows of up to ``height`` levels above, where the run (``n`` nodes on this level) still has more than one node below.

    2**height nodes meet in one row, and their parents are made there level by level.
    """
    under = level.groupBy("run_id", "level", "n", F.shiftright("idx", height).alias("i"))
    made = under.agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]).alias("a0"))
    for k in range(height):
        own = F.col(f"a{k}")
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / 2).cast("int")), parent_in(own))
        more = F.ceil(F.col("n") / float(1 << k)) > 1
        made = made.withColumn(f"a{k + 1}", F.when(more & (F.size(own) > 0), pairs).otherwise(F.array().cast("array<string>")))
    levels = F.array(*[F.struct(F.lit(k).alias("up"), F.col(f"a{k}").alias("digests")) for k in range(1, height + 1)])
    each = made.select("run_id", "level", "i", F.explode(levels).alias("l")).select("run_id", "level", "i", "l.up", F.posexplode("l.digests").alias("j", "digest"))
    idx = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(height) - F.col("up")) * F.col("i") + F.col("j")
    return each.select("run_id", (F.col("level") + F.col("up")).alias("level"), idx.cast("long").alias("idx"), "digest")


def tree(leaf_rows: DataFrame) -> DataFrame:
    """All levels up to the roots, ``HEIGHT`` of them in a job.  A run of one leaf has it as its root."""
    whole = level = written(leaf_rows, "merkle")
    at = 0
    while True:
        sizes = level.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if sizes.isEmpty():
            return whole
        above = written(parents(level.join(sizes, "run_id")), "merkle")
        at += HEIGHT
        whole, level = whole.unionByName(above), above.where(F.col("level") == at)


def roots(whole: DataFrame) -> DataFrame:
    return whole.groupBy("run_id").agg(F.max_by("digest", "level").alias("root"), (F.max("level") + 1).alias("levels"))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (run_id, level, idx, left_digest, right_digest) where two trees differ."""
    keys = ["run_id", "level", "idx"]
    both = a.select(*keys, F.col("digest").alias("left_digest")).join(b.select(*keys, F.col("digest").alias("right_digest")), keys, "full")
    return both.where(~F.col("left_digest").eqNullSafe(F.col("right_digest")))


def serialised(whole: DataFrame) -> DataFrame:
    """Rows (run_id, text): each tree's digests in pre-order, joined by '|'; for runs whose tree one value can hold.

    In pre-order a node comes before what is below it, so nodes sort by the leaf where their subtree starts, then from the top.
    """
    first = F.pow(F.lit(2.0), "level").cast("long") * F.col("idx")
    listed = F.sort_array(F.collect_list(F.struct(first.alias("first"), (-F.col("level")).alias("up"), "digest")))
    return whole.groupBy("run_id").agg(F.array_join(F.transform(listed, lambda n: n["digest"]), "|").alias("text"))


def parsed(text: str, leaf_count: int) -> list[tuple[int, int, str]]:
    """(level, idx, digest) of a serialised tree, given how many leaves it has."""
    sizes = [leaf_count]
    while sizes[-1] > 1:
        sizes.append((sizes[-1] + 1) // 2)
    nodes = [(idx << level, -level, level, idx) for level, size in enumerate(sizes) for idx in range(size)]
    digests = text.split("|") if text else []
    if len(digests) != len(nodes):
        raise ValueError("the text does not fit a tree of so many leaves")
    return sorted((level, idx, d) for (*_, level, idx), d in zip(sorted(nodes), digests, strict=True))
