"""Predicates on keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of keys that hold structures, and their kinds.
RESERVED = {"bf_": "bloom", "cms_": "cms", "hll_": "hll", "sh_": "simhash", "tb_": "token_bucket"}


def is_reserved(key: str | Column = "key") -> Column:
    k, out = F.col(key) if isinstance(key, str) else key, F.lit(False)
    for p in RESERVED:
        out = out | k.startswith(p)
    return out


def kind(key: str = "key") -> Column:
    out = F
    for p, name in RESERVED.items():
        out = out.when(F.col(key).startswith(p), name)
    return out.otherwise("user")


def key_head(key: str | Column, n: int) -> Column:
    """The first n bytes in lower case, or the whole key if it is shorter."""
    k = F.col(key) if isinstance(key, str) else key
    return F.lower(F.decode(F.substring(F.encode(k, "UTF-8"), 1, n), "UTF-8"))


def has_prefix(prefix: str, case_sensitive: bool = False, key: str = "key", folded: str | None = None) -> Column:
    """``folded``: a stored column of lower-cased keys, on which the predicate can be pushed to the scan."""
    if case_sensitive:
        return F.col(key).startswith(prefix)
    return (F.col(folded) if folded else F.lower(key)).startswith(prefix.lower())


def in_range(low: str, high: str, case_sensitive: bool = False, key: str = "key", folded: str | None = None) -> Column:
    """Both ends included."""
    if case_sensitive:
        return F.col(key).between(low, high)
    return (F.col(folded) if folded else F.lower(key)).between(low.lower(), high.lower())
