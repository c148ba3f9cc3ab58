"""Hash and bit expressions; every one is a built-in Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seed_bytes(seed: int) -> bytes:
    """A hash function's seed: 4 bytes, big-endian, in a block of 32."""
    return seed.to_bytes(4, "big") + bytes(28)


def word64(x: str | Column, seed: int | None = None) -> Column:
    """The first 8 bytes of MD5 over the value (and a seed block) as the bits of a long."""
    data = col(x).cast("binary")
    if seed is not None:
        data = F.concat(data, F.lit(seed_bytes(seed)))
    return F.conv(F.substring(F.md5(data), 1, 16), 16, -10).cast("long")


def unsigned_mod(h: Column, m: int) -> Column:
    """A long's bits, read as unsigned, modulo m: twice the upper 63 bits, and the lowest."""
    return (((F.shiftrightunsigned(h, 1) % m) * 2 + h.bitwiseAND(F.lit(1).cast("long"))) % m).cast("int")


def top_bits(h: Column, p: int) -> Column:
    """The highest p bits; none are 0 (a shift by 64 would be none in the JVM)."""
    return F.lit(0) if p == 0 else F.shiftrightunsigned(h, 64 - p).cast("int")


def trailing_zeros(h: Column) -> Column:
    return F.when(h == 0, F.lit(64)).when(h == -(2**63), F.lit(63)).otherwise(F.bit_count(h.bitwiseAND(-h) - 1)).cast("int")


def hamming(a: str | Column, b: str | Column) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b))).cast("int")


def pack64(h: str | Column) -> Column:
    """Eight bytes, the highest bit first."""
    return F.unhex(F.lpad(F.hex(col(h)), 16, "0"))


def unpack64(b: str | Column) -> Column:
    return F.conv(F.hex(col(b)), 16, -10).cast("long")


def hex64(h: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(col(h)), 16, "0"))


def big_endian(x: Column, size: int) -> Column:
    """The lowest ``size`` bytes of an integer, highest first."""
    return F.unhex(F.right(F.lpad(F.hex(x.cast("long")), 16, "0"), F.lit(2 * size)))


def record_crc(key: str = "key", value: str = "value", ts: str = "ts", tombstone: str = "tombstone") -> Column:
    """CRC-32 of a record: time in whole seconds, tombstone, sizes, key and value; null is empty."""
    k, v = F.coalesce(F.col(key).cast("binary"), F.lit(b"")), F.coalesce(F.col(value).cast("binary"), F.lit(b""))
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.crc32(F.concat(big_endian(seconds, 8), big_endian(F.col(tombstone).cast("int"), 1), big_endian(F.octet_length(k), 8), big_endian(F.octet_length(v), 8), k, v))
