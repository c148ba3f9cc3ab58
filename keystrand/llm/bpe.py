"""BPE encoding and decoding through a distinct-word table.

1. Each task splits its documents into words and gathers chunks: a list of distinct words, and the documents as positions
   in that list.  Chunks are written once to the shared folder.
2. The chunks' words are dealt to buckets by a hash.  A bucket's task encodes every distinct word once, by the library,
   and answers each chunk with the ids of the words it asked for.  A word occurs once per chunk at most, however
   frequent it is, and a bucket holds its distinct words only.
3. The answers meet their chunk, the ids are put back by position, and the ids are decoded through the table of
   ids and pieces (as many entries as the vocabulary has).

Words are the white-space parts of a text; the library's normaliser and pre-tokenizer never look across white space, so a
text's ids are its words' ids in turn.  A text with a control character that only Python takes for white space is one word.

Null text counts as empty text; rows that repeat, null ids and other columns do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.llm.common import as_binary, slices, written
from keystrand.llm.words import WordEncoder, load, lowered

#: A chunk ends when it has as many distinct words or code points.
CHUNK_WORDS = 500_000
CHUNK_CHARS = 32_000_000
#: Text bytes for each bucket of words.
BUCKET_BYTES = 64_000_000
ODD = "\x1c\x1d\x1e\x1f"


class Index(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def split_words(text: str) -> list[str]:
    return [text] if any(c in text for c in ODD) else lowered(text).split()


def gather_chunks(docs: DataFrame, n_buckets: int, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Rows (chunk, bucket, body): of bucket -1 the documents of a chunk, of the others its distinct words there.

    Positions number the words from the most frequent one down, so that they compress; the documents' row has each
    word's bucket, and the words of a bucket keep that order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, press = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1).compress
        index, ids, sizes, places, chars = Index(), [], [], [], 0

        def finish() -> pa.RecordBatch:
            words = list(index)
            of = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % n_buckets for w in words], dtype=np.int64)
            place = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
            order = np.argsort(-np.bincount(place, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), dtype="<u4")
            rank[order] = np.arange(len(words))
            of, place = of[order], rank[place]
            known = np.array([i is not None for i in ids], dtype=np.uint8).tobytes()
            head = np.array([len(ids), len(words), len(place)], dtype="<i8").tobytes()
            rows = [(chunk, -1, press(head + known + np.array([i or 0 for i in ids], dtype="<i8").tobytes() + np.array(sizes, dtype="<i8").tobytes() + planes(of) + planes(place)))]
            dealt = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[dealt], np.arange(n_buckets + 1))
            for k in range(n_buckets):
                if cuts[k] < cuts[k + 1]:
                    own = [words[j].encode("utf-8", "surrogatepass") for j in order[dealt[cuts[k] : cuts[k + 1]]].tolist()]
                    rows.append((chunk, k, press(len(own).to_bytes(4, "little") + planes(np.fromiter(map(len, own), dtype=np.int64)) + b"".join(own))))
            a, b, c = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), as_binary(list(c))], names=["chunk", "bucket", "body"])

        for b in batches:
            texts, doc_ids = [t or "" for t in b.column(1).to_pylist()], b.column(0).to_pylist()
            for i, j in slices(texts, min(2_000_000, 8 * chunk_words)):
                parts = [split_words(t) for t in texts[i:j]]
                ids += doc_ids[i:j]
                sizes += map(len, parts)
                places.append(np.fromiter(map(index.__getitem__, chain.from_iterable(parts)), dtype=np.int64))
                chars += sum(map(len, texts[i:j]))
                if len(index) >= chunk_words or chars >= CHUNK_CHARS:
                    yield finish()
                    chunk, index, ids, sizes, places, chars = chunk + 1, Index(), [], [], [], 0
        if ids:
            yield finish()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "chunk long, bucket int, body binary")


def encode_words(requests: DataFrame, tokenizer: str, n_buckets: int) -> DataFrame:
    """Answer each (chunk, bucket, words) with (chunk, bucket, ids of the words in turn)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press, unpress = WordEncoder(tokenizer, drops_space=True, kept=0), zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        bucket, table = None, {}
        for b in batches:
            out = []
            for k, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != bucket:
                    bucket, table = k, {}
                raw = unpress(body)
                n = int.from_bytes(raw[:4], "little")
                ends = np.cumsum(from_planes(raw, n, 4), dtype=np.int64) + 4 * (n + 1)
                words = [raw[i:j] for i, j in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]
                if new := [w for w in words if w not in table]:
                    table.update(zip(new, encoder.encode_parts([w.decode("utf-8", "surrogatepass") for w in new]), strict=True))
                found = [table[w] for w in words]
                out.append(press(n.to_bytes(4, "little") + planes(np.fromiter(map(len, found), dtype=np.int64) // 4) + planes(np.frombuffer(b"".join(found), dtype="<u4"))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), as_binary(out)], names=["chunk", "bucket", "body"])

    return requests.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, "chunk long, bucket int, body binary")


def planes(values: np.ndarray) -> bytes:
    """32-bit integers as four planes of bytes."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=4 * n, offset=at).reshape(4, n).T).view("<u4").ravel()


def _restored(body: bytes, answers: list[bytes], unpress) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of the documents of a chunk."""
    raw, lengths, flat = unpress(body), [], []
    for a in answers:
        whole = unpress(a)
        n = int.from_bytes(whole[:4], "little")
        lengths.append(from_planes(whole, n, 4))
        flat.append(from_planes(whole, len(whole) // 4 - n - 1, 4 * (n + 1)))
    n_docs, n_words, n_places = np.frombuffer(raw, dtype="<i8", count=3).tolist()
    at = 24
    known = np.frombuffer(raw, dtype=np.uint8, count=n_docs, offset=at).tolist()
    ids = np.frombuffer(raw[at + n_docs : at + 9 * n_docs], dtype="<i8").tolist()
    sizes = np.frombuffer(raw[at + 9 * n_docs : at + 17 * n_docs], dtype="<i8")
    of, place = (from_planes(raw, n, at + 17 * n_docs + skip) for n, skip in ((n_words, 0), (n_places, 4 * n_words)))
    dealt = np.argsort(of, kind="stable")  # the words in the order of the answers
    words = np.concatenate(flat) if flat else np.zeros(0, dtype="<u4")
    length, first = np.zeros(n_words, dtype=np.int64), np.zeros(n_words, dtype=np.int64)
    if n_words:
        answered = np.concatenate(lengths).astype(np.int64)
        length[dealt], first[dealt] = answered, np.cumsum(answered) - answered
    end = 0
    for k, i, size in zip(known, ids, sizes.tolist(), strict=True):
        own = place[end : end + size]
        end += size
        n = length[own]
        stop = np.cumsum(n)
        total = int(stop[-1]) if size else 0
        yield (i if k else None), words[np.repeat(first[own] - stop + n, n) + np.arange(total)].astype("<u4")


def bpe_round_trip(docs: DataFrame, tokenizer: str, n_buckets: int | None = None, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    if n_buckets is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_buckets = max(8, math.ceil(size / BUCKET_BYTES))
    gathered = written(gather_chunks(docs, n_buckets, chunk_words), "word-chunks")
    answers = encode_words(gathered.where("bucket >= 0"), tokenizer, n_buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, unpress = load(tokenizer), zstandard.ZstdDecompressor().decompress
        pieces = [(library.id_to_token(i) or "").encode() for i in range(max(library.get_vocab().values()) + 1)]
        between = b" " if library.decoder is None else None
        waiting: list[bytes] = []
        for b in batches:
            for kind, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if kind >= 0:
                    waiting.append(body)
                    continue
                rows = []
                for doc_id, ids in _restored(body, waiting, unpress):
                    listed = ids.tolist()
                    text = between.join(map(pieces.__getitem__, listed)) if between is not None else library.decode(listed, skip_special_tokens=False).encode()
                    rows.append((doc_id, len(listed), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
                waiting = []
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    # The answers of a chunk come first, in the order of their buckets, then its documents.
    both = answers.unionByName(gathered.where("bucket < 0")).withColumn("last", F.col("bucket") < 0)
    return both.repartition("chunk").sortWithinPartitions("chunk", "last", "bucket").drop("last").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
