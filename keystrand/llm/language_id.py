"""Language identification by partial matching.

Each language has a byte context tree of order ``ORDER``: counts of every byte after its last 3, 2, 1 and 0 bytes.  A byte's
code length is that of partial matching with escape method C and no exclusions: in a context seen T times with D distinct
successors, a known byte costs -log2(c / (T + D)), any other costs the escape -log2(D / (T + D)) and then what it costs in the
next shorter context; below the empty context all 256 bytes are equal.  Contexts that a language never met cost nothing to
leave.  After fitting, the statistics are frozen: code lengths are compiled to tables in units of 2**-16 bit, so a text's
lengths are exact integer sums and depend on nothing but the text.  The language of the shortest code wins, ties going to
the smaller name.

The trees are fitted on a sample of labelled documents for each language: those of the lowest hash of the id over the whole
table until ``TRAIN_BYTES`` are reached, all if there are fewer, so every labelled language is learned.  Documents of null text or null label are never learned from.

A null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing was learned.  The score is
the posterior of the winner under equal priors when the evidence of long texts is scaled to ``SCORE_BYTES`` bytes.
Rows with a null id are predicted but not learned from.  Repeated rows, extra columns and empty tables do no harm.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.llm.common import held, lean, slices

ORDER = 3
TRAIN_BYTES = 2_000_000
SCORE_BYTES = 64
#: The hash that picks the sample has so many parts, and each of them as many again.
DRAWS = 1000
#: Rows, and code points, that are coded at a time.
ROWS, SLICE = 1000, 500_000
#: Code length units of one bit.
UNIT = 1 << 16
#: A-Z count as a-z; the byte before a text's start.
FOLD = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
PAD = 10


def fold_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets); null as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return FOLD[data[offsets[0] : offsets[-1]]], offsets - offsets[0]


def contexts(data: np.ndarray, offsets: np.ndarray, bits: int = 8, pad_with: int = PAD) -> np.ndarray:
    """The three bytes, or other symbols of so many bits, before each, within its text."""
    padded = np.concatenate([np.full(3, pad_with, dtype=np.uint8), data]).astype(np.uint32)
    out = padded[:-3] << np.uint32(2 * bits) | padded[1:-2] << np.uint32(bits) | padded[2:-1]
    starts, ends = offsets[:-1], offsets[1:]
    for k in range(3):
        own = starts[starts + k < ends] + k
        keep = np.uint32((1 << (bits * k)) - 1)
        pad = sum(pad_with << (bits * j) for j in range(k, 3))
        out[own] = (out[own] & keep) | np.uint32(pad)
    return out


def count_grams(sample: DataFrame) -> DataFrame:
    """Rows (lang, gram, n): how often each byte follows each three bytes; gram is context * 256 + byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                own = b.column(1).filter(pa.array(langs == lang))
                for i in range(0, len(own), ROWS):
                    data, offsets = fold_texts(own.slice(i, ROWS))
                    grams, n = np.unique(contexts(data, offsets).astype(np.int64) << 8 | data, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def _reached(rows: DataFrame, part: Column, before: dict[str, int], train_bytes: int) -> dict[str, tuple[int | None, int]]:
    """{language: (the part of the hash in which its bytes reach ``train_bytes``, the bytes before it)}; None where they don't."""
    found: dict[str, dict[int, int]] = {}
    for r in rows.groupBy("lang", part.alias("part")).agg(F.sum(F.octet_length("text")).alias("b")).collect():
        found.setdefault(r["lang"], {})[r["part"]] = r["b"]
    out: dict[str, tuple[int | None, int]] = {}
    for lang, parts in found.items():
        total = before.get(lang, 0)
        out[lang] = (None, total)
        for k in sorted(parts):
            if total + parts[k] >= train_bytes:
                out[lang] = (k, total)
                break
            total += parts[k]
    return out


def fit(docs: DataFrame, learn: Column, train_bytes: int = TRAIN_BYTES) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """{language: (grams, counts)} from the rows where ``learn`` holds; no more entries than the sample has bytes."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(DRAWS * DRAWS))
    coarse = _reached(rows, F.floor(draw / DRAWS), {}, train_bytes)
    edges = {lang: first for lang, (first, _) in coarse.items() if first is not None}
    at_edge = _any((F.col("lang") == lang) & (F.floor(draw / DRAWS) == first) for lang, first in edges.items())
    fine = _reached(rows.where(at_edge), draw % DRAWS, {lang: coarse[lang][1] for lang in edges}, train_bytes) if edges else {}
    share = _any((F.col("lang") == lang) & (F.lit(True) if first is None else draw <= first * DRAWS + fine[lang][0]) for lang, (first, _) in sorted(coarse.items()))
    found: dict[str, tuple[list[int], list[int]]] = {}
    for r in count_grams(rows.where(share)).toLocalIterator():
        grams, n = found.setdefault(r["lang"], ([], []))
        grams.append(r["gram"])
        n.append(r["n"])
    out = {}
    for lang, (grams, n) in sorted(found.items()):
        order = np.argsort(grams)
        out[lang] = (np.array(grams, dtype=np.int64)[order], np.array(n, dtype=np.int64)[order])
    return out


class Coder:
    """Compiled code lengths: ``rows`` maps three bytes to a context's row, ``costs[row, symbol class, language]``."""

    def __init__(self, model: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(model)
        seen = np.unique(np.concatenate([g & 255 for g, _ in model.values()]))
        self.classes = np.full(256, len(seen), dtype=np.int64)  # the last class: bytes that no language has
        self.classes[seen] = np.arange(len(seen))
        self.width = len(seen) + 1
        known = {k: np.unique(np.concatenate([(g >> 8) & ((1 << 8 * k) - 1) for g, _ in model.values()])) for k in (3, 2, 1)}
        base = {0: 0, 1: 1, 2: 1 + len(known[1]), 3: 1 + len(known[1]) + len(known[2])}
        total = base[3] + len(known[3])
        # Contexts are looked up by numbers of their bytes; a byte that stands in no context has the last, of no context's row.
        inside = np.unique(np.append(known[1], PAD))
        self.number, self.bits = np.full(256, len(inside), dtype=np.uint8), int(len(inside)).bit_length()
        self.number[inside] = np.arange(len(inside))
        short = [sum(self.number[known[k] >> 8 * j & 255].astype(np.int64) << self.bits * j for j in range(k)) for k in (1, 2, 3)]
        self.rows = np.zeros(1 << 3 * self.bits, dtype=np.int32)
        self.rows.reshape(-1, 1 << self.bits)[:, short[0]] = base[1] + np.arange(len(known[1]))
        self.rows.reshape(-1, 1 << 2 * self.bits)[:, short[1]] = base[2] + np.arange(len(known[2]))
        self.rows[short[2]] = base[3] + np.arange(len(known[3]))
        self.costs = np.zeros((total, self.width, len(self.languages)), dtype=np.int32)
        for k, lang in enumerate(self.languages):
            grams, n = model[lang]
            lower = np.full((1, self.width), 8.0)
            for order in range(ORDER + 1):
                own = known[order] if order else np.zeros(1, dtype=np.int64)
                at = np.searchsorted(own, (grams >> 8) & ((1 << 8 * order) - 1)) if order else np.zeros(len(grams), dtype=np.int64)
                counts = np.zeros((len(own), self.width))
                np.add.at(counts, (at, self.classes[grams & 255]), n)
                below = lower if order < 2 else lower[np.searchsorted(known[order - 1], own & ((1 << 8 * (order - 1)) - 1))]
                with np.errstate(divide="ignore", invalid="ignore"):
                    times, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
                    found = np.where(counts > 0, -np.log2(counts / (times + kinds)), -np.log2(kinds / (times + kinds)) + below)
                lower = np.where(times > 0, found, below)
                self.costs[base[order] : base[order] + len(own), :, k] = np.rint(lower * UNIT)
        self.costs = self.costs.reshape(total * self.width, len(self.languages))

    def lengths(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(code lengths by text and language, bytes of each text)."""
        data, offsets = fold_texts(column)
        sizes = np.diff(offsets)
        out = np.zeros((len(sizes), len(self.languages)), dtype=np.int64)
        ctx, full = contexts(self.number[data], offsets, self.bits, int(self.number[PAD])), np.flatnonzero(sizes)
        step = 1 << 18
        for a in range(0, len(data), step):
            b = min(a + step, len(data))
            costs = self.costs[self.rows[ctx[a:b]].astype(np.int64) * self.width + self.classes[data[a:b]]]
            first, last = np.searchsorted(offsets[:-1][full], [a, b - 1], side="right") - 1
            own = full[first : last + 1]
            out[own] += np.add.reduceat(costs, np.maximum(offsets[own] - a, 0), axis=0, dtype=np.int64)
        return out, sizes


def predict(docs: DataFrame, model: dict[str, tuple[np.ndarray, np.ndarray]], carry: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """Rows (*carry, text if asked for, lang_pred, score, bits_per_byte): the winner's posterior and code length."""
    import uuid

    spark = docs.sparkSession
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(("coder", name), lambda: Coder(shared.value)) if shared.value else None
        for b in batches:
            n = len(b)
            if coder is None:
                found = [pa.array(["und"] * n), pa.array([0.0] * n), pa.array([None] * n, pa.float64())]
            else:
                lettered, parts = [], []
                for i in range(0, n, ROWS):
                    texts = b.column(0).slice(i, ROWS).to_pylist()
                    lettered += [t is not None and next(filter(str.isalpha, t), None) is not None for t in texts]
                    parts += [coder.lengths(b.column(0).slice(i + p, q - p)) for p, q in slices(texts, SLICE)]
                lettered = np.array(lettered, dtype=bool)
                lengths, sizes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else coder.lengths(b.column(0))
                best = lengths.argmin(axis=1)
                least = lengths.min(axis=1)
                scale = np.minimum(sizes, SCORE_BYTES) / np.maximum(sizes, 1) / UNIT
                score = 1 / np.exp2(-(lengths - least[:, None]) * scale[:, None]).sum(axis=1)
                names = np.where(lettered, np.array(coder.languages, dtype=object)[best], "und")
                found = [pa.array(names.tolist(), pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(least / UNIT / np.maximum(sizes, 1), mask=~lettered)]
            yield pa.RecordBatch.from_arrays([*b.columns[first:], *found], names=[*b.schema.names[first:], "p0", "p1", "p2"])

    first = 0 if keep_text else 1
    rows = docs.select(F.col("text").alias("c"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)])
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[first:]) + "p0 string, p1 double, p2 double"
    out = rows.mapInArrow(lean(run), schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)], *[F.col("c").alias("text")] * keep_text, F.col("p0").alias("lang_pred"), F.col("p1").alias("score"), F.col("p2").alias("bits_per_byte"))


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 3
