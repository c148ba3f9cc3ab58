"""Reads of the current state: points, batches, prefixes, ranges, pages and iteration."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from keystrand.functions.keys import has_prefix, in_range, is_reserved
from keystrand.operators.log import latest, live, visible


def get(log: DataFrame, key: str, include_reserved: bool = False) -> DataFrame:
    """The key's live row, or none."""
    return visible(latest(log.where((F.col("key") == key) & (F.lit(include_reserved) | ~is_reserved()))))


def multi_get(log: DataFrame, requests: DataFrame, include_reserved: bool = False) -> DataFrame:
    """Each requested key once with its live row, or nulls."""
    wanted = requests.select("key").distinct()
    return wanted.join(live(log.join(wanted, "key", "left_semi"), include_reserved), "key", "left")


def _scan(log: DataFrame, predicate, include_reserved: bool) -> DataFrame:
    return live(log.where(predicate), include_reserved)


def prefix_scan(log: DataFrame, prefix: str, case_sensitive: bool = False, include_reserved: bool = False, folded: str | None = None) -> DataFrame:
    return _scan(log, has_prefix(prefix, case_sensitive, folded=folded), include_reserved)


def range_scan(log: DataFrame, low: str, high: str, case_sensitive: bool = False, include_reserved: bool = False, folded: str | None = None) -> DataFrame:
    return _scan(log, in_range(low, high, case_sensitive, folded=folded), include_reserved)


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) in ascending order of keys; past the end it is empty."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return rows.orderBy("key").offset((number - 1) * size).limit(size)


def page_after(rows: DataFrame, last_key: str | None, size: int) -> DataFrame:
    """The page after a key: no deeper page costs more than the first."""
    return (rows if last_key is None else rows.where(F.col("key") > last_key)).orderBy("key").limit(size)


def iterate(rows: DataFrame) -> Iterator[Row]:
    """Rows in ascending order of keys; the driver holds a partition at a time."""
    return rows.orderBy("key").toLocalIterator(prefetchPartitions=True)


def iterate_steps(rows: DataFrame, size: int = 10) -> Iterator[list[Row]]:
    """Batches of ``size`` by keyset pages, for readers that stop early."""
    last = None
    while batch := page_after(rows, last, size).collect():
        yield batch
        last = batch[-1]["key"]
