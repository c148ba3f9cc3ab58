"""Token-bucket admission of ordered events, for each key.

A bucket starts full at its key's first event.  The whole time units since the last refill add tokens, up to the capacity; the
refill time moves only when tokens are added, and then to the event's time.  An event takes a token or is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.functions.hashing import big_endian


def step(state: tuple[int, int] | None, now: int, capacity: int, rate: int, unit: int) -> tuple[tuple[int, int], bool]:
    """(tokens, last refill) before an event at ``now`` to those after it, and whether it is admitted."""
    tokens, last = state or (capacity, now)
    if (more := (now - last) // unit * rate) > 0:
        tokens, last = min(capacity, tokens + more), now
    return (tokens - 1, last) if tokens > 0 else (0, last), tokens > 0


def admit(events: DataFrame, capacity: int, rate: int, unit_seconds: int = 1, key: str = "key", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Rows (key, seq, ts, admitted, tokens): tokens are those left after the event.

    A recurrence over a key's events: they are sorted (spilling as needed) and streamed, so a task holds one state,
    however many events a key has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, unit = (), None, unit_seconds * 1_000_000
        for b in batches:
            admitted, tokens = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (k,) != current:
                    current, state = (k,), None
                state, good = step(state, t, capacity, rate, unit)
                admitted.append(good)
                tokens.append(state[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(admitted), pa.array(tokens, pa.int64())], names=["key", "seq", "ts", "admitted", "tokens"])

    timed = events.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    kind = timed.schema["key"].dataType.simpleString(), timed.schema["ts"].dataType.simpleString()
    return timed.repartition("key").sortWithinPartitions("key", "us", "seq").mapInArrow(run, f"key {kind[0]}, seq long, ts {kind[1]}, admitted boolean, tokens long")


def payload(capacity: str, rate: str, tokens: str, last_nanos: str):
    """A bucket's state as 32 bytes: three big-endian integers and the time in nanoseconds, little-endian."""
    return F.concat(big_endian(F.col(capacity), 8), big_endian(F.col(rate), 8), big_endian(F.col(tokens), 8), F.unhex(_reversed_hex(last_nanos)))


def _reversed_hex(column: str):
    whole = F.lpad(F.hex(F.col(column).cast("long")), 16, "0")
    return F.concat(*[F.substring(whole, 15 - 2 * k, 2) for k in range(8)])
