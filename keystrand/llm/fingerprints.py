"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for each i, the sum of (c_j + 1) * B^j over its first i code points, modulo a prime,
for two bases.  The difference of two entries, times a power of B's inverse, is the hash of that span wherever it
stands, so spans compare in constant time and the longest common extension of two positions is a binary search.

A fingerprint is 16 hex digits of length-aware whole-text hash, then the smallest distinct 32-bit mixes of the hashes of
all windows of ``WINDOW`` code points (the whole text where it is shorter), ascending, 8 hex digits each: ``KEPT`` of them, or
one for each ``EACH`` code points if that is more.  The likeness of two fingerprints is 1 if their whole-text hashes are equal.
If not, it is the share of the values up to the point that both sketches reach that both hold, an estimate of the windows'
Jaccard similarity J with a standard error of sqrt(J * (1 - J) / m) for m values, and at most m / (m + 1).

Null text counts as empty.  Ties of a doc_id are ordered by a hash of the text; a null doc_id comes last in descending order.  An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.llm.common import lean, ordered_chunks, unzipped

#: Modulus (a Mersenne prime) and the two bases.
PRIME = np.uint64(2**31 - 1)
BASES = (916_191_201, 1_368_015_347)
WINDOW = 16
KEPT = 64
EACH = 64
#: Multiplier that mixes a window's hash before the smallest are taken.
MIX = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of a base and of its inverse, grown as texts need them."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, int(PRIME))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, m, int(PRIME))) % PRIME])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, int(PRIME))) % PRIME])


POWERS = tuple(Powers(b) for b in BASES)


class PrefixHash:
    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums = []
        for p in POWERS:
            p.reach(self.n + 1)
            s = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(points * p.up[: self.n] % PRIME, out=s[1:])
            self.sums.append(s % PRIME)

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Hash of the code points from i up to j, the same wherever the span stands."""
        p = int(PRIME)
        return tuple((int(s[j]) - int(s[i])) % p * int(w.down[i]) % p for s, w in zip(self.sums, POWERS, strict=True))

    def same(self, i: int, j: int, other: PrefixHash, k: int) -> bool:
        """Whether the span from i up to j stands in ``other`` from k."""
        return i <= j <= self.n and k + j - i <= other.n and self.span(i, j) == other.span(k, k + j - i)

    def extension(self, i: int, other: PrefixHash, k: int) -> int:
        """Length of the longest common extension from i here and from k in ``other``."""
        low, high = 0, min(self.n - i, other.n - k)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.same(i, i + mid, other, k) else (low, mid - 1)
        return low

    def windows(self, width: int = WINDOW) -> np.ndarray:
        """Mixed hashes of all windows of ``width``, by start."""
        m = self.n - width + 1
        if m <= 0:
            return np.zeros(0, dtype=np.uint32)
        return mixed(*(((s[width:] + PRIME - s[:m]) % PRIME) * p.down[:m] % PRIME for s, p in zip(self.sums, POWERS, strict=True)))

    def whole(self) -> tuple[int, int, int]:
        return (self.n, *(int(s[-1]) for s in self.sums))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (((a << np.uint64(31)) | b) * MIX >> np.uint64(32)).astype(np.uint32)


def spliced(a: PrefixHash, h: int, b: PrefixHash, m: int, wa: np.ndarray, wb: np.ndarray, width: int = WINDOW) -> tuple[tuple[int, int, int], list[np.ndarray]]:
    """Whole hash and window hashes of a's first h code points followed by b's first m, from the two prefix arrays."""
    p = int(PRIME)
    whole = (h + m, *((int(x[h]) + int(w.up[h]) * int(y[m])) % p for x, y, w in zip(a.sums, b.sums, POWERS, strict=True)))
    first = max(0, h - width + 1)
    starts = np.arange(first, min(h, h + m - width + 1)) if m else np.zeros(0, dtype=np.int64)
    cross = []
    if len(starts):
        for x, y, w in zip(a.sums, b.sums, POWERS, strict=True):
            left = (x[h] + PRIME - x[starts]) % PRIME * w.down[starts] % PRIME
            cross.append((left + w.up[h - starts] * y[width - (h - starts)]) % PRIME)
        cross = [mixed(*cross)]
    return whole, [wa[: max(0, h - width + 1)], *cross, wb[: max(0, m - width + 1)]]


def sketch(windows: list[np.ndarray], whole: tuple[int, int, int]) -> np.ndarray:
    """The smallest distinct window values, ascending; of a text shorter than a window, its whole hash."""
    kept = max(KEPT, whole[0] // EACH)
    values = np.concatenate(windows) if len(windows) > 1 else windows[0]
    if not len(values):
        return mixed(np.array([whole[1]], dtype=np.uint64), np.array([whole[2]], dtype=np.uint64)) if whole[0] else values.astype(np.uint32)
    if len(values) > 8 * kept:
        least = np.unique(np.partition(values, 4 * kept)[: 4 * kept])
        if len(least) >= kept:
            return least[:kept]
    return np.unique(values)[:kept]


def head(whole: tuple[int, int, int]) -> str:
    return f"{((whole[1] << 31 | whole[2]) * 0x9E3779B97F4A7C15 + whole[0]) & (2**64 - 1):016x}"


def printed(whole: tuple[int, int, int], values: np.ndarray) -> str:
    return head(whole) + values.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, equal: bool) -> float:
    """``equal``: whether the whole texts are.  A sketch of fewer than ``KEPT`` values has all of its text's."""
    if equal:
        return 1.0
    union = np.union1d(a, b)
    reach = [x[-1] for x in (a, b) if len(x) >= KEPT]
    if reach:
        union = union[: np.searchsorted(union, min(reach), side="right")]
    if not len(union):
        return 0.0
    return float(min(np.isin(union, np.intersect1d(a, b)).mean(), len(union) / (len(union) + 1)))


def fingerprint_likeness(a: str, b: str) -> float:
    """Likeness from two printed fingerprints."""
    return likeness(*(np.frombuffer(bytes.fromhex(x[16:]), dtype=">u4").astype(np.uint32) for x in (a, b)), a[:16] == b[:16])


def _heads(docs: DataFrame, bounds: list[int]) -> dict[int, int | None]:
    """The largest id of each chunk that has rows, None if it has null ids only; one number for each chunk of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, most = np.array(bounds, dtype=np.int64), {}
        for b in batches:
            known = b.column(0).drop_null().to_numpy(zero_copy_only=False)
            if len(known) < len(b):
                most.setdefault(0, None)
            chunk = np.searchsorted(edges, known, side="left")
            for c in np.unique(chunk).tolist():
                head = int(known[chunk == c].max())
                most[c] = head if most.get(c) is None else max(most[c], head)
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.int64())], names=["chunk", "head"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "chunk int, head long")
    return {r["chunk"]: r["head"] for r in found.groupBy("chunk").agg(F.max("head").alias("head")).toLocalIterator()}


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edit: the last half of its code points replaced by the first as many of the next
    document in descending id order (after the last, the first).

    Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix);
    common_prefix is the longest common extension of the two texts' starts.
    """
    chunks, bounds = ordered_chunks(docs)
    heads = _heads(docs, bounds)
    order = sorted(heads)
    after: dict[int | None, list[int]] = {}  # the chunks that need a chunk's first document as the successor of their last
    for k, c in enumerate(order):
        after.setdefault(heads[order[k - 1]], []).append(c)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = ["chunk", "doc_id", "tie", "ztext", "tail"]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.zeros(len(b), dtype=np.int8))], names=names)
            extra = [(c, i, k) for k, i in enumerate(b.column(1).to_pylist()) for c in after.get(i, ())]
            if extra:
                c, i, k = zip(*extra, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int64()), *(b.column(j).take(pa.array(k)) for j in (2, 3)), pa.array(np.ones(len(c), dtype=np.int8))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (chunk, id, text, prefix hash, windows, sketch, whole)
        ended = None  # the chunk whose successor came already

        def measure(text: str):
            own = PrefixHash(text)
            w = own.windows()
            return own, w, sketch([w], own.whole())

        for b in batches:
            rows: list[tuple] = []
            chunk, ids, tail = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist()
            for c, i, z, t in zip(chunk, ids, b.column(3).to_pylist(), tail, strict=True):
                if t and ended == c:
                    continue
                text = unzipped([z])[0].decode("utf-8", "replace")
                own, w, s = measure(text)
                if last is not None and last[0] == c:
                    rows.append(_edited(last[1:], (text, own, w, s)))
                last, ended = (None, c) if t else ((c, i, text, own, w, s), ended)
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names=NAMES)

    dealt = chunks.mapInArrow(lean(copy), "chunk int, doc_id long, tie binary, ztext binary, tail byte")
    n = len(bounds) + 1
    ordered = dealt.repartitionById(n, F.col("chunk")).sortWithinPartitions("chunk", "tail", F.desc_nulls_last("doc_id"), F.desc_nulls_last("tie"))
    return ordered.mapInArrow(lean(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]


def _edited(this: tuple, following: tuple) -> tuple:
    doc_id, text, own, windows, values = this
    next_text, next_own, next_windows, next_values = following
    half = own.n // 2
    h, m = own.n - half, min(half, next_own.n)
    whole, parts = spliced(own, h, next_own, m, windows, next_windows)
    edited_values = sketch(parts, whole)
    edited = hashlib.sha256((text[:h] + next_text[:m]).encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, own.n, edited, printed(own.whole(), values), printed(whole, edited_values), likeness(values, edited_values, head(own.whole()) == head(whole)), likeness(values, next_values, head(own.whole()) == head(next_own.whole())), own.extension(0, next_own, 0))
