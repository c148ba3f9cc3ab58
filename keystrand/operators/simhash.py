"""SimHash of word weights, Hamming distance, and near duplicates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.functions.hashing import hamming, word64

#: Characters that are deleted, and words without weight.
PUNCTUATION = ".,?!;:-()\"+"
STOP_WORDS = ("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with").split()
#: Six blocks of a fingerprint: pairs within three bits agree on three of them.
BLOCKS = (11, 11, 11, 11, 10, 10)
DISTANCE = 3


def words(text: str | Column) -> Column:
    """Lower-cased words without punctuation and stop words; null text has none."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    parts = F.split(F.lower(F.translate(t, PUNCTUATION, "")), r"(?U)\s+")
    return F.filter(parts, lambda w: (w != "") & ~w.isin(STOP_WORDS))


def word_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, word, n): how often a text has a word."""
    return docs.select(id_col, F.explode(words(text_col)).alias("word")).groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): bit k, from the highest, is set if the words' hashes with it outweigh those without; 0 for no words.

    A word's weight is its frequency, so every occurrence votes once and no aggregation by word is needed; a text's votes are
    summed before the shuffle.
    """
    votes = docs.select(id_col, F.explode_outer(words(text_col)).alias("w")).select(id_col, word64("w").alias("h"))
    sums = [F.sum(F.shiftrightunsigned("h", 63 - k).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{k}") for k in range(64)]
    counted = votes.groupBy(id_col).agg(F.count("h").alias("n"), *sums)
    fp = F.lit(0).cast("long")
    for k in range(64):
        bit = 1 << (63 - k)
        fp = fp.bitwiseOR(F.when(F.col(f"b{k}") * 2 > F.col("n"), F.lit(bit - 2**64 if bit >= 2**63 else bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(id_col, fp.alias("fp"))


def distance_of(prints: DataFrame, pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (a, b, distance) for pairs (a, b) of ids; a pair with an unknown id raises nothing and is left out."""
    a, b = (prints.select(F.col(id_col).alias(x), F.col("fp").alias("fp" + x)) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", hamming("fpa", "fpb").alias("distance"))


def _choices() -> list[int]:
    parts, at = [], 0
    for n in BLOCKS:
        parts.append(((1 << n) - 1) << at)
        at += n
    return [m - 2**64 if (m := sum(c)) >= 2**63 else m for c in combinations(parts, len(BLOCKS) - DISTANCE)]


def classes(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, representative): the smallest id of equal fingerprints."""
    first = prints.groupBy("fp").agg(F.min(id_col).alias("representative"))
    return prints.join(first, "fp").select(id_col, "representative")


def near_duplicates(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (a, b, distance): representatives of different fingerprints within three bits, a below b.

    A pair counts under the first choice of blocks that it shares, so each is found once.
    """
    first = prints.groupBy("fp").agg(F.min(id_col).alias("id"))
    masks = _choices()
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])
    keyed = first.select("id", "fp", F.posexplode(keys).alias("choice", "key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    shared = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(c)) for c, m in enumerate(masks)])
    near = (F.col("a.id") < F.col("b.id")) & (hamming("a.fp", "b.fp") <= DISTANCE) & (F.col("a.choice") == shared)
    met = a.join(b, (F.col("a.choice") == F.col("b.choice")) & (F.col("a.key") == F.col("b.key")) & near)
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), hamming("a.fp", "b.fp").alias("distance"))
