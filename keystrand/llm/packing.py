"""Best-fit packing of token sequences.

Documents are encoded, cut into pieces of at most ``capacity`` tokens, and the pieces are packed by bounded-space
online best-fit: a task keeps a fixed number of open bins in a bitset keyed by free space, puts each piece into the open
bin with the least sufficient space, and closes the fullest bin when a new one would exceed the bound.  Pieces arrive in
bounded lots, each placed from the longest down.

Null text counts as empty; an empty document is the end id alone; repeated rows are packed each; columns other than
the id and the text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.llm.common import lean, written
from keystrand.llm.words import worker_encoder

CAPACITY = 2048
#: Words that a Python worker keeps, some 250 bytes each.
KEPT_WORDS = 400_000
#: Bins a packing task holds open.
OPEN_BINS = 2048
#: Pieces that arrive together and are placed from the longest down, so that short ones fill what long ones leave.
ARRIVALS = 4000
#: Pieces that a packing task aims at: many, so that the bins it leaves open at its end are few beside those it fills.
PIECES_A_TASK = 200_000


class OpenBins:
    """A bounded set of open bins; bit s of ``bits`` is set while a bin with s tokens of free space is open."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.bits, self.count = capacity, limit, 0, 0
        self.by_space: list[list[list[int]]] = [[] for _ in range(capacity + 1)]

    def _push(self, space: int, members: list[int]) -> None:
        self.by_space[space].append(members)
        self.bits |= 1 << space
        self.count += 1

    def _pop(self, space: int) -> list[int]:
        members = self.by_space[space].pop()
        if not self.by_space[space]:
            self.bits ^= 1 << space
        self.count -= 1
        return members

    def add(self, item: int, length: int) -> list[int] | None:
        """Place an item; returns the members of a bin that closed by it."""
        if length == self.capacity:
            return [item]
        closed, fits = None, self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            members = self._pop(space)
        else:
            if self.count >= self.limit:
                closed = self._pop((self.bits & -self.bits).bit_length() - 1)
            space, members = self.capacity, []
        members.append(item)
        if space == length:
            return members  # full
        self._push(space - length, members)
        return closed

    def rest(self) -> Iterator[list[int]]:
        while self.bits:
            yield self._pop((self.bits & -self.bits).bit_length() - 1)


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32), cut so that only the first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_encoder(tokenizer, drops_space=False, kept=kept_words), end_id.to_bytes(4, "little")
        for b in batches:
            ids, rows = b.column(0).to_pylist(), ([], [], [], [], [])
            for doc_id, raw in zip(ids, encoder.encode(b.column(1).to_pylist()), strict=True):
                raw, n = raw + end, len(raw) // 4 + 1
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k in range(len(cuts) - 1):
                    for out, v in zip(rows, (doc_id, k, cuts[k], cuts[k + 1] - cuts[k], zlib.crc32(raw[4 * cuts[k] : 4 * cuts[k + 1]])), strict=True):
                        out.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK) -> DataFrame:
    """Add (sequence_id, offset) to rows with a ``length``; each sequence is gapless from 0 and at most ``capacity``.

    Pieces are dealt to tasks by a hash, so that no source or key fills one task, and in an order that mixes sizes.
    """
    n = max(1, round(pieces.count() / pieces_a_task))
    fields = pieces.schema.fieldNames()
    at = fields.index("length")
    mixed = F.xxhash64("doc_id", "piece", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base, closed = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40, 0
        kept: dict[int, tuple] = {}
        rows: list[tuple] = []

        def close(members: list[int]) -> None:
            nonlocal closed
            offset = 0
            for m in members:
                row = kept.pop(m)
                rows.append((*row, base + closed, offset))
                offset += row[at]
            closed += 1

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return batch

        def place() -> None:
            nonlocal seen
            arrived.sort(key=lambda row: -row[at])
            for row in arrived:
                kept[seen] = row
                if members := bins.add(seen, row[at]):
                    close(members)
                seen += 1
            arrived.clear()

        schema, seen, arrived = None, 0, []
        for b in batches:
            schema = schema or pa.schema([*b.schema, pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())])
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                arrived.append(row)
                if len(arrived) == ARRIVALS:
                    place()
            if rows:
                yield out()
        place()
        for members in bins.rest():
            close(members)
        if rows:
            yield out()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return pieces.repartition(n, mixed).sortWithinPartitions(mixed, *fields).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one per piece."""
    return pack(written(encode_pieces(docs, tokenizer, end_id, capacity, kept_words), "pieces"), capacity)
