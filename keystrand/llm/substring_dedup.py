"""Substring dedup: remove passages of ``width`` words or more that occurred before.

1. Documents are dealt to chunks of ascending ids, each a task's work.  A chunk takes the Rabin-Karp hash of every window of
   ``width`` consecutive words (a polynomial in the words' 64-bit hashes, modulo 2**64, from prefix sums) and sends each
   distinct one, once, to a bucket by its value, sorted and delta coded.
2. A bucket counts each hash over the chunks and answers every chunk but the earliest with those of its hashes that an earlier
   chunk has.  A window is sent once per chunk however often it repeats there, so a hot passage is no hot key.
3. A chunk meets its answers: a window repeats if its hash was answered or occurred earlier in the chunk.  Overlapping repeated
   windows merge into maximal intervals, and their words are removed.

Windows are judged on the input.  "Earlier" is a smaller doc_id, or an earlier start in the same document; null ids come
first, and rows that share a doc_id are ordered by a hash of the text.  Words are runs of anything but the six ASCII white spaces.  Null
text has no words; texts shorter than a window lose nothing; an empty table gives no rows.  Two different windows share
a 64-bit hash with a chance of about n*n / 2**65 over n windows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.llm.common import as_binary, by_chunk, held, lean, ordered_chunks, unzipped

WIDTH = 20
#: Text bytes for each chunk: a task holds some ten numbers for each word of one.
CHUNK_BYTES = 5_000_000
#: Text bytes for each bucket of hashes.
BUCKET_BYTES = 9_000_000
#: The polynomial's base, odd, and words whose hashes a worker keeps.
BASE = 0x9E3779B97F4A7C15
KEPT_WORDS = 100_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


class Windows:
    """Hashes of all windows of a list of texts, and where they start."""

    def __init__(self, width: int):
        self.width, self.words, self.up, self.down = width, WordHashes(), np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            inverse = pow(BASE, -1, 2**64)
            steps = np.empty((2, n), dtype=np.uint64)
            steps[0], steps[1], steps[:, 0] = BASE, inverse, 1
            self.up, self.down = np.cumprod(steps, axis=1)

    def hash_words(self, text: bytes) -> np.ndarray:
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        parts = text.split()
        return np.fromiter(map(self.words.__getitem__, parts), dtype=np.uint64, count=len(parts))

    def of(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts among all words, words of each text), given the texts' word hashes."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        values = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint64)
        n = len(values)
        self._powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        last = np.repeat(np.cumsum(sizes), sizes)
        starts = np.flatnonzero(np.arange(n) + self.width <= last)
        return (sums[starts + self.width] - sums[starts]) * self.down[starts], starts, sizes


def worker_windows(width: int) -> Windows:
    return held(("windows", width), lambda: Windows(width))


def packed_hashes(values: np.ndarray) -> bytes:
    """Ascending distinct values as a first value and differences of one width."""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + values[:1].astype("<u8").tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked_hashes(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(steps) + 1, 8), dtype=np.uint8)
    wide[1:, :width] = steps
    out = wide.view("<u8").ravel()
    out[0] = np.frombuffer(data, dtype="<u8", count=1, offset=1)[0]
    return np.cumsum(out, dtype=np.uint64)


def send_hashes(chunks: DataFrame, n_chunks: int, n_buckets: int, width: int) -> DataFrame:
    """Rows (bucket, chunk, body): a chunk's distinct window hashes by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, texts, current = worker_windows(width), [], None

        def finish() -> pa.RecordBatch:
            values = np.unique(windows.of(texts)[0])
            of = ((values >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
            cuts = np.searchsorted(of, np.arange(n_buckets + 1, dtype=np.uint64))
            own = [k for k in range(n_buckets) if cuts[k] < cuts[k + 1]]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([current] * len(own), pa.int32()), as_binary([packed_hashes(values[cuts[k] : cuts[k + 1]]) for k in own])], names=["bucket", "chunk", "body"])

        for b in batches:
            for chunk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if chunk != current and texts:
                    yield finish()
                    texts = []
                current = chunk
                texts.append(windows.hash_words(unzipped([text])[0]))
        if texts:
            yield finish()

    return by_chunk(chunks.select("chunk", "ztext"), n_chunks, []).mapInArrow(lean(run), "bucket int, chunk int, body binary")


def answer_hashes(sent: DataFrame, n_buckets: int) -> DataFrame:
    """Rows (chunk, body): those of a chunk's hashes that an earlier chunk has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chunks, bodies = None, [], []

        def finish() -> pa.RecordBatch:
            parts = [unpacked_hashes(x) for x in bodies]  # in ascending order of chunks
            values, of = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            order = np.argsort(values, kind="stable")
            again = order[1:][values[order[1:]] == values[order[:-1]]]
            again.sort()
            of, found = of[again], values[again]
            own = np.unique(of)
            cuts = np.searchsorted(of, [*own, len(parts)])
            return pa.RecordBatch.from_arrays([pa.array([chunks[k] for k in own], pa.int32()), as_binary([packed_hashes(found[cuts[k] : cuts[k + 1]]) for k in range(len(own))])], names=["chunk", "body"])

        for b in batches:
            for bucket, chunk, body in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != current and chunks:
                    yield finish()
                    chunks, bodies = [], []
                current = bucket
                chunks.append(chunk)
                bodies.append(body)
        if chunks:
            yield finish()

    return sent.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket", "chunk").mapInArrow(lean(run), "chunk int, body binary")


def cut(text: bytes, removed: np.ndarray, keep_space: bool) -> bytes:
    """The text without the removed words; the others joined by one space, or with the white space that stood before each."""
    if not keep_space:
        return b" ".join([w for w, r in zip(text.split(), removed.tolist(), strict=True) if not r])
    if not removed.any():
        return text
    out, start, gone = [], 0, False  # start: of the run of kept words, its leading white space included
    for m, now in zip(WORD.finditer(text), removed.tolist(), strict=True):
        if now and not gone:
            out.append(text[start : m.start()])
        elif gone and not now:
            start = m.start()
        gone = now
    return b"".join(out) if gone else b"".join(out) + text[start:]


def dedup_substrings(docs: DataFrame, width: int = WIDTH, keep_space: bool = False, carry: tuple[str, ...] = (), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, removed, kept, *carry).

    removed: the maximal intervals (start, end) of removed words, end exclusive.  carry: columns of ``docs`` to return.
    """
    chunks, bounds = ordered_chunks(docs, chunk_bytes=chunk_bytes, carry=carry)
    n_chunks = len(bounds) + 1
    n_buckets = max(1, math.ceil(n_chunks * chunk_bytes / BUCKET_BYTES))
    answers = answer_hashes(send_hashes(chunks, n_chunks, n_buckets, width), n_buckets)
    carried = [f for f in chunks.schema.fields if f.name.startswith("carry")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, current, known, rows, hashed = worker_windows(width), None, [], [], []

        def finish() -> Iterator[pa.RecordBatch]:
            values, starts, sizes = windows.of(hashed)
            order = np.argsort(values, kind="stable")
            repeated = np.zeros(len(values), dtype=bool)
            repeated[order[1:][values[order[1:]] == values[order[:-1]]]] = True
            if known and len(values):
                earlier = np.sort(np.concatenate(known))
                at = np.minimum(np.searchsorted(earlier, values), len(earlier) - 1)
                repeated |= earlier[at] == values
            change = np.zeros(int(sizes.sum()) + 1, dtype=np.int32)
            hit = starts[repeated]
            change[hit] += 1
            np.subtract.at(change, hit + width, 1)
            removed, end, out = np.cumsum(change)[:-1] > 0, 0, []
            for (doc_id, text, *extra), n in zip(rows, sizes.tolist(), strict=True):
                own = removed[end : end + n]
                end += n
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                spans = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
                kept = None if text is None and keep_space else cut(text or b"", own, keep_space).decode("utf-8", "replace")
                out.append((doc_id, n, int(own.sum()), spans, kept, *extra))
                if len(out) == 2000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        arrow = None
        for b in batches:
            if arrow is None:
                own = [pa.field("doc_id", pa.int64()), pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.field("kept", pa.string())]
                arrow = pa.schema([*own, *(b.schema.field(k) for k in range(6, b.num_columns))])
            for chunk, body, doc_id, ztext, is_doc, _, *extra in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk != current and rows:
                    yield from finish()
                    known, rows, hashed = [], [], []
                elif chunk != current:
                    known = []
                current = chunk
                if not is_doc:
                    known.append(unpacked_hashes(body))
                    continue
                text = None if ztext is None else unzipped([ztext])[0]
                rows.append((doc_id, text, *extra))
                hashed.append(windows.hash_words(text or b""))
        if rows:
            yield from finish()

    docs_part = chunks.select("chunk", F.lit(None).cast("binary").alias("body"), "doc_id", "ztext", F.lit(True).alias("is_doc"), "tie", *[f.name for f in carried])
    answers_part = answers.select("chunk", "body", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("ztext"), F.lit(False).alias("is_doc"), F.lit(None).cast("binary").alias("tie"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in carried])
    both = answers_part.unionByName(docs_part).repartitionById(n_chunks, F.col("chunk")).sortWithinPartitions("chunk", "is_doc", "doc_id", "tie")
    schema = "doc_id long, n_words long, n_removed long, removed array<struct<start: int, end: int>>, kept string" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in carried)
    out = both.mapInArrow(lean(run), schema)
    return out.select("doc_id", "n_words", "n_removed", "removed", "kept", *[F.col(f.name).alias(c) for f, c in zip(carried, carry, strict=True)])
