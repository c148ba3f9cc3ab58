"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's word shingles.  Two
fingerprints within ``DISTANCE`` bits leave at least three of six blocks untouched, so they share one of the twenty
choices of three blocks.  Distinct fingerprints are joined on these choices and verified by their Hamming distance.  A
group that shares a choice is searched as a graph: what leaves it is a spanning forest of its links, never all pairs.  A
group larger than ``TILE`` is cut into tiles, and each pair of tiles is searched by a task of its own.  Links then make
components by rounds of contraction, each a written table.

Texts of fewer words than a shingle have the whole sequence as their shingle; texts without words, and null texts, have
fingerprint zero, linked like any other.  Copies share a fingerprint and are never compared.  Rows with a null doc_id
are kept and don't name a component; a component of such rows alone has a null component_id.  An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrand.llm.common import held, lean, slices, written

SEED = 42
DISTANCE = 3
#: Bits of the six blocks, from the lowest.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of a group that one task compares with one another.
TILE = 2048


def masks(blocks: tuple[int, ...] = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Masks of all choices of blocks that a pair within the distance may have in common."""
    parts, at = [], 0
    for n in blocks:
        parts.append(((1 << n) - 1) << at)
        at += n
    return [sum(c) for c in combinations(parts, len(blocks) - distance)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def text_fingerprints(texts: list[bytes], width: int = 3) -> np.ndarray:
    """Fingerprints of UTF-8 texts as unsigned 64-bit integers."""
    hashes, sizes, digest = [], [], xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split()  # of bytes: A-Z only, and the six ASCII white spaces only
        if len(words) <= width:
            hashes += [digest(b" ".join(words), SEED)] if words else []
            sizes.append(1 if words else 0)
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes += [digest(line[i:j], SEED) for i, j in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
        sizes.append(len(words) - width + 1)
    sizes = np.array(sizes, dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.uint64)
    if not len(hashes):
        return out
    # Bits become bytes, added eight at a time: runs of at most 255 rows can't overflow a byte.
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
    ends = np.cumsum(sizes)
    full = np.flatnonzero(sizes)
    runs = [np.arange(e - s, e, 255) for s, e in zip(sizes[full].tolist(), ends[full].tolist(), strict=True)]
    some = np.add.reduceat(bits, np.concatenate(runs), axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    heads = np.cumsum([0, *map(len, runs)])[:-1]
    counts = np.add.reduceat(some, heads, axis=0)
    over = counts * 2 > sizes[full][:, None]
    out[full] = np.packbits(over, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, *carry, fp), the fingerprint's 64 bits as a signed long; ``carry`` names columns of strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("fingerprints",), dict)  # lets go of what another operator kept in this worker
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            found = [text_fingerprints(texts[i:j]) for i, j in slices(texts, 1_000_000)]
            fp = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(fp.view(np.int64))], names=["doc_id", *carry, "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text", *carry).mapInArrow(lean(run), "".join(["doc_id long, ", *(f"{c} string, " for c in carry), "fp long"]))


def spanning_links(values: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links (of indexes) that connect the same values as all pairs within the distance do."""
    left, links = np.arange(len(values)), []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        front = [root]
        while front and len(left):
            near = np.bitwise_count(values[left] ^ values[front.pop()]) <= distance
            found = left[near]
            if len(found):
                links += [(root, int(i)) for i in found]
                front += found.tolist()
                left = left[~near]
    return links


def near_links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows (a, b): links between distinct fingerprints ``fp`` that connect what all close pairs connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []

        def links() -> list[tuple[int, int]]:
            if len(members) == 2:
                a, b = members
                return [(a, b)] if ((a ^ b) & (2**64 - 1)).bit_count() <= DISTANCE else []
            values = np.array(members, dtype=np.int64)
            return [(members[i], members[j]) for i, j in spanning_links(values.view(np.uint64))]

        for b in batches:
            out = []
            for fp, *own in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if own != group:
                    out += links() if len(members) > 1 else []
                    group, members = own, []
                members.append(fp)
            if out:
                x, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])
        if len(members) > 1 and (out := links()):
            x, y = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks()])
    blocked = distinct.select("fp", F.posexplode(keys).alias("choice", "key"))
    group = Window.partitionBy("choice", "key")
    shared = blocked.withColumn("n", F.count(F.lit(1)).over(group)).where("n > 1")
    placed = shared.withColumn("own", F.floor((F.row_number().over(group.orderBy("fp")) - 1) / tile).cast("int"))
    tiles = F.ceil(F.col("n") / tile).cast("int")
    # A tile meets itself and every other tile of its group; in a group of several tiles, pairs of different tiles hold both anyway.
    met = F.when(tiles == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), tiles - 1), lambda x: x != F.col("own")))
    paired = placed.select("fp", "choice", "key", "own", F.explode(met).alias("other"))
    paired = paired.select("fp", "choice", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    keyed = paired.repartition("choice", "key", "low", "high").sortWithinPartitions("choice", "key", "low", "high", "fp")
    return keyed.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) of all linked nodes; nodes of a component share a root.

    Each round every node takes its neighbour (or itself) of the least hash, and the links are drawn again between those:
    the nodes left fall by a constant factor, whatever their order.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    links, labels = written(links, "links"), None
    while not links.isEmpty():
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        chosen = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", rank("a"))["v"].alias("root"))
        chosen = written(chosen, "chosen")
        if labels is None:
            labels = chosen
        else:
            step = chosen.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = written(labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        a, b = (chosen.select(F.col("node").alias(x), F.col("root").alias("r" + x)) for x in "ab")
        moved = links.join(a, "a").join(b, "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        links = written(moved.distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows (doc_id, fp, component_id): the smallest doc_id that links lead to, the document's own included."""
    marked = written(fingerprints(docs), "fingerprints")
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(marked.select("fp").distinct(), tile))
    rooted = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "root")
    least = rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows (doc_id, digest): of each component, the least of its rows that have an id; ``docs`` has a digest of the text."""
    marked = written(fingerprints(docs, ("digest",)), "fingerprints")
    first = marked.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    roots = components(near_links(marked.select("fp").distinct(), tile))
    rooted = first.join(roots, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), "first")
    return rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
