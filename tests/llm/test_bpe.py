import hashlib

import numpy as np

from keystrand.llm import bpe
from keystrand.llm.queries import op7_bpe_round_trip, vocabulary
from keystrand.llm.words import load


def check(rows, documents):
    tokenizer = load(vocabulary("word_bpe_49k.json"))
    wanted = []
    for doc_id, text in documents:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        wanted.append((doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(wanted, key=key)


def test_whole_table(spark):
    where = "/root/testdata/sf0.01"
    check(op7_bpe_round_trip(spark, where).collect(), spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect())


def test_odd_rows_in_many_chunks(spark, odd_documents):
    rows, schema = odd_documents
    rows = [*rows, (40, "a\x1cb <|startoftext|>c ÀÉ ǅ İ", *rows[0][2:])]
    for n_buckets, chunk_words in ((1, 1000), (7, 3)):
        check(bpe.bpe_round_trip(spark.createDataFrame(rows, schema), vocabulary("word_bpe_49k.json"), n_buckets, chunk_words).collect(), [(r[0], r[1]) for r in rows])


def test_empty_table(spark, store, odd_documents):
    assert op7_bpe_round_trip(spark, store(documents=([], odd_documents[1]))).count() == 0
