"""Token-id files in Simple-8b word-aligned coding.

A file is ``MAGIC``, the 64-bit words, and a footer.  The top four bits of a word select how many ids its other 60 bits
hold and at which width (``SELECTORS``, the published table, with one selector given to escapes); an id of more than 60
bits is an escape word that holds an index into the footer's list of escaped ids.  Ids are coded in blocks of ``BLOCK``;
the footer has each block's offset in words and in ids, so blocks decode independently and a whole range of blocks
decodes in a few vector operations per selector.  The footer also has the documents: ids and lengths.

Documents are written in ascending doc_id order (null first, ties by a hash of the text), one file per range chunk.  Null text is empty
text; each document ends with the end id; repeated rows are written each; an empty table writes no file.
A file is written under a new name and renamed; only files named in the manifest count, so a lost or repeated task leaves
nothing that is read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrand.llm.common import by_chunk, lean, ordered_chunks, unzipped, written
from keystrand.llm.words import worker_encoder
from keystrand.plans.storage import fresh_path, hadoop

MAGIC = b"KSIDS8B1"
#: Selector -> (ids in a word, bits of each).  Selector 0 is an escape.
SELECTORS = ((1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([c for c, _ in SELECTORS], dtype=np.int64)
BLOCK = 512
#: Ids that are coded at a time.
SEGMENT = 1_000_000


def _widths(ids: np.ndarray) -> np.ndarray:
    out, rest = np.zeros(len(ids), dtype=np.uint8), ids.copy()
    while rest.any():
        out += rest != 0
        rest >>= np.uint64(1)
    return out


def _selectors(widths: np.ndarray) -> np.ndarray:
    """For each start, the selector that packs the most of the ids from there on."""
    n = len(widths)
    most = {1: np.concatenate([widths, np.zeros(max(c for c, _ in SELECTORS), dtype=np.uint8)])}
    for size in sorted({c for c, _ in SELECTORS} - {1}):
        half = max(s for s in most if s <= size and 2 * s >= size)
        wide = most[half].copy()
        np.maximum(wide[: len(wide) - size + half], most[half][size - half :], out=wide[: len(wide) - size + half])
        most[size] = wide
    out = np.zeros(n, dtype=np.uint8)
    for s, (count, bits) in reversed(list(enumerate(SELECTORS))):
        if s:
            out[most[count][:n] <= bits] = s
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escaped ids)."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, dtype="<u8"), np.zeros(0, dtype=np.int64), ids
    selected = _selectors(_widths(ids))
    starts, at = np.zeros(n, dtype=bool), np.arange(0, n, block)
    ends = np.minimum(at + block, n)
    while len(at):
        starts[at] = True
        at = at + COUNTS[selected[at]]
        open_ = at < ends
        at, ends = at[open_], ends[open_]
    first = np.flatnonzero(starts)
    chosen, last = selected[first], np.minimum((first // block + 1) * block, n)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(SELECTORS):
        if not s or not bits:
            continue
        own = np.flatnonzero(chosen == s)
        value = np.zeros(len(own), dtype=np.uint64)
        for k in range(count):
            p = first[own] + k
            value |= np.where(p < last[own], ids[np.minimum(p, n - 1)], np.uint64(0)) << np.uint64(k * bits)
        words[own] |= value
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words.astype("<u8"), np.searchsorted(first, np.arange(0, n, block)), ids[first[escaped]]


def decode(words: np.ndarray, first_words: np.ndarray, first_ids: np.ndarray, n: int, escaped: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks, given where each block starts among the words and among the ids."""
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    chosen = (words >> np.uint64(60)).astype(np.int64)
    before = np.cumsum(COUNTS[chosen]) - COUNTS[chosen]
    block = np.repeat(np.arange(len(first_words)), np.diff([*first_words, len(words)]))
    start = before - before[first_words][block] + first_ids[block]
    last = np.append(first_ids[1:], n)[block]
    for s, (count, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(chosen == s)
        if not len(own) or not bits:
            continue
        value, at, end = words[own] & np.uint64(2**60 - 1), start[own], last[own]
        if not s:
            out[at] = escaped[value.astype(np.int64)]
            continue
        for k in range(count):
            good = at + k < end
            out[at[good] + k] = (value[good] >> np.uint64(k * bits)) & np.uint64(2**bits - 1)
    return out


class Writer:
    """One file of documents' ids, built in memory segment by segment; the coded words are what it holds."""

    def __init__(self, segment: int = SEGMENT):
        self.segment = segment
        self.words, self.first_words, self.first_ids, self.escaped, self.docs = [], [], [], [], []
        self.n_words = self.n_ids = self.n_escaped = 0
        self.waiting: list[bytes] = []
        self.n_waiting = 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        """raw: the document's ids as little-endian unsigned 32-bit integers."""
        self.docs.append((doc_id, len(raw) // 4))
        self.waiting.append(raw)
        self.n_waiting += len(raw) // 4
        if self.n_waiting >= self.segment:
            self.flush()

    def flush(self) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype="<u4").astype(np.uint64)
        words, first, escaped = encode(ids)
        if self.n_escaped:
            words[words >> np.uint64(60) == 0] += np.uint64(self.n_escaped)
        self.words.append(words.tobytes())
        self.first_words.append(first + self.n_words)
        self.first_ids.append(np.arange(0, len(ids), BLOCK) + self.n_ids)
        self.escaped.append(escaped)
        self.n_words, self.n_ids, self.n_escaped = self.n_words + len(words), self.n_ids + len(ids), self.n_escaped + len(escaped)
        self.waiting, self.n_waiting = [], 0

    def close(self) -> bytes:
        self.flush()
        parts = [
            np.concatenate(self.first_words).astype("<i8"),
            np.concatenate(self.first_ids).astype("<i8"),
            np.concatenate(self.escaped).astype("<u8"),
            np.array([d is not None for d, _ in self.docs], dtype="<i8"),
            np.array([d or 0 for d, _ in self.docs], dtype="<i8"),
            np.array([n for _, n in self.docs], dtype="<i8"),
        ]
        footer = b"".join(p.tobytes() for p in parts) + struct.pack("<6Q", self.n_words, self.n_ids, len(parts[0]), len(parts[2]), len(self.docs), len(MAGIC))
        return MAGIC + b"".join(self.words) + footer


def read(data: bytes) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, first id's place in the file, ids as little-endian unsigned 32-bit integers) of each document."""
    n_words, n_ids, n_blocks, n_escaped, n_docs, skip = struct.unpack("<6Q", data[-48:])
    if data[:skip] != MAGIC:
        raise ValueError("not a token-id file")
    words, at = np.frombuffer(data, dtype="<u8", count=n_words, offset=skip), skip + 8 * n_words
    fields = []
    for kind, n in (("<i8", n_blocks), ("<i8", n_blocks), ("<u8", n_escaped), ("<i8", n_docs), ("<i8", n_docs), ("<i8", n_docs)):
        fields.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
        at += 8 * n
    first_words, first_ids, escaped, known, doc_ids, lengths = fields
    raw, start = decode(words, first_words, first_ids, n_ids, escaped).astype("<u4").tobytes(), 0
    for k, d, n in zip(known.tolist(), doc_ids.tolist(), lengths.tolist(), strict=True):
        yield d if k else None, start, raw[4 * start : 4 * (start + n)]
        start += n


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Hadoop has it in, so that a worker doesn't take it for a local one."""
    store, where = hadoop(spark, path)
    return store.makeQualified(where).toString()


def _local(path: str) -> str | None:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:") if path.startswith("file:") else path if "://" not in path else None


def save(path: str, data: bytes) -> None:
    """Write under another name, then rename."""
    draft = f"{path}.{uuid.uuid4().hex}"
    if local := _local(path):
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(_local(draft), "wb") as f:
            f.write(data)
        os.replace(_local(draft), local)
        return
    from pyarrow import fs

    store, draft_path = fs.FileSystem.from_uri(draft)
    with store.open_output_stream(draft_path) as f:
        f.write(data)
    store.move(draft_path, fs.FileSystem.from_uri(path)[1])


def fetch(path: str) -> bytes:
    if local := _local(path):
        with open(local, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return f.read()


def write_token_files(docs: DataFrame, directory: str, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files; returns their manifest (chunk, path, n_docs, n_ids, n_bytes, crc32), a written table of a row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, current, writer = worker_encoder(tokenizer, drops_space=True), end_id.to_bytes(4, "little"), None, Writer()

        def finish() -> pa.RecordBatch:
            data = writer.close()
            path = f"{directory}/chunk-{current:09d}-{uuid.uuid4().hex}.ids"
            save(path, data)
            row = (current, path, len(writer.docs), writer.n_ids, len(data), zlib.crc32(data))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["chunk", "path", "n_docs", "n_ids", "n_bytes", "crc32"])

        for b in batches:
            texts = [t.decode("utf-8", "replace") for t in unzipped(b.column(3).to_pylist())]
            for chunk, doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoder.encode(texts), strict=True):
                if chunk != current and current is not None:
                    yield finish()
                    writer = Writer()
                current = chunk
                writer.add(doc_id, raw + end)
        if current is not None:
            yield finish()

    chunks, bounds = ordered_chunks(docs)
    manifest = by_chunk(chunks, len(bounds) + 1, ["doc_id", "tie"]).mapInArrow(lean(run), "chunk int, path string, n_docs long, n_ids long, n_bytes long, crc32 long")
    return written(manifest, "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) decoded from the files; start counts the ids of all documents before.

    The running sum over files takes one row per file (16 MB of text) to one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, crc, base in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                data = fetch(path)
                if zlib.crc32(data) != crc:
                    raise ValueError(f"{path} has been altered")
                rows = [(d, base + at, len(raw) // 4, zlib.crc32(raw)) for d, at, raw in read(data)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    order = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("chunk", "path", "crc32", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).cast("long").alias("base"))
    files = based.repartitionById(max(1, manifest.count()), F.col("chunk")).select("path", "crc32", "base")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    spark = docs.sparkSession
    return read_token_files(write_token_files(docs, qualified(spark, fresh_path(spark, "token-ids")), tokenizer, end_id))
