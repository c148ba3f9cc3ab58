"""Token-bucket admission over a stream: one small state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keystrand.operators.token_bucket import step


class Bucket(StatefulProcessor):
    def __init__(self, capacity: int, rate: int, unit_seconds: int):
        self.capacity, self.rate, self.unit = capacity, rate, unit_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        whole = pd.concat(list(rows)).sort_values(["us", "seq"])  # a key's events of one micro-batch: bound it by the source's trigger
        admitted, tokens = [], []
        for us in whole["us"].tolist():
            state, good = step(state, us, self.capacity, self.rate, self.unit)
            admitted.append(good)
            tokens.append(state[0])
        self.state.update(state)
        yield pd.DataFrame({"key": key[0], "seq": whole["seq"].to_numpy(), "admitted": admitted, "tokens": tokens})

    def close(self) -> None:
        pass


def admit_stream(events: DataFrame, capacity: int, rate: int, unit_seconds: int = 1) -> DataFrame:
    """Rows (key, seq, admitted, tokens) of a stream (key, seq, ts); a batch's events are taken in the order of time.

    Events without a time are left out.  Needs the RocksDB state store provider.
    """
    timed = events.where(F.col("ts").isNotNull()).select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return timed.groupBy("key").transformWithStateInPandas(Bucket(capacity, rate, unit_seconds), "key string, seq long, admitted boolean, tokens long", "append", "none")
