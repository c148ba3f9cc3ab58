"""Stages of the corpus pipeline: each takes documents and returns documents, the last one packed pieces.

A stage works on all its predecessor kept, and returns the columns it was given (``text`` and, where there is one, ``n_chars``
follow its decisions).  Columns are carried through by place, so no name can clash with an operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.llm import language_id as li
from keystrand.llm.common import prepare, table, written
from keystrand.llm.line_dedup import dedup_lines
from keystrand.llm.packing import pack_documents
from keystrand.llm.queries import vocabulary
from keystrand.llm.simhash_dedup import representatives
from keystrand.llm.substring_dedup import dedup_substrings

#: Code length, in bits a byte, above which no learned language explains a text better than random bytes would be.
MOST_BITS = 8.0
#: Words that a packing worker keeps here, where the JVM has grown with the stages before.
KEPT_WORDS = 150_000


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", "text"))


def _like(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars counted again."""
    own = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in docs.columns else {}
    return found.select(*[own.get(c, F.col(f"`{c}`")) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what is no text of a learned language: null, without a letter, or costlier than random bytes; a missing label is filled in.

    Without a column ``lang`` nothing can be learned, so that raises.
    """
    if "lang" not in docs.columns:
        raise ValueError("language identification learns from a column lang, which these documents don't have")
    model = li.fit(docs, li.fold_of() != 1)
    others = [c for c in docs.columns if c != "text"]
    names = {c: f"held{k}" for k, c in enumerate(others)}
    found = li.predict(docs.select("text", *[F.col(f"`{c}`").alias(n) for c, n in names.items()]), model, tuple(names.values()), keep_text=True)
    keep = found.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MOST_BITS))
    own = {"text": F.col("text"), "lang": F.coalesce(F.col(names["lang"]), F.col("lang_pred"))}
    return keep.select(*[own.get(c, F.col(names.get(c, c))).alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that resemble an earlier one; a document stays, be it without lines."""
    others = _others(docs)
    names = tuple(f"held{k}" for k in range(len(others)))
    found = dedup_lines(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)]), names)
    return _like(found.select("doc_id", "text", *[F.col(n).alias(c) for c, n in zip(others, names, strict=True)]), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near copies the row of the smallest id, then digest of the text, once; rows without an id aren't judged.

    Rows that share an id are told apart by their texts.
    """
    digest = F.coalesce(F.md5("text"), F.lit(""))
    first = representatives(docs.select("doc_id", "text", digest.alias("digest")))
    whole = docs.where("doc_id is not null").select("doc_id", digest.alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = whole.join(first, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 20 words or more that occurred before; what stays keeps its white space."""
    others = _others(docs)
    names = tuple(f"held{k}" for k in range(len(others)))
    found = dedup_substrings(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)]), keep_space=True, carry=names)
    return _like(found.select("doc_id", F.col("kept").alias("text"), *[F.col(n).alias(c) for c, n in zip(others, names, strict=True)]), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), kept_words=KEPT_WORDS)


def shipped(stage):
    """The stage, with the package sent to the workers before."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", shipped(identify_language)),
    ("line_dedup", shipped(drop_repeated_lines)),
    ("simhash_near_dedup", shipped(drop_near_copies)),
    ("substring_dedup", shipped(cut_repeated_passages)),
    ("best_fit_packing", shipped(pack_sequences)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
