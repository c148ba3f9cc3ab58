import zlib
from collections import defaultdict

import numpy as np
import pytest

from keystrand.llm import packing
from keystrand.llm.queries import op1_best_fit_packing, vocabulary
from keystrand.llm.words import WordEncoder, load, packed

EDGES = ["", "a", " a", "  a", "a  b", "a   b ", "a\nb", "a\n b", "a \nb", "a\x1cb c", "<|endoftext|> x<|endoftext|>y", "it's  's a's", "İΣ Σσς éa", "a b  c", "\ta b\t", "日本 語", " ", "\n", "x ", " <|startoftext|>"]


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_word_encoder_equals_library(name, drops):
    encoder = WordEncoder(vocabulary(name), drops, kept=5)
    texts = [*EDGES, *EDGES[::-1], " ".join(EDGES), None]
    assert encoder.encode(texts) == packed(load(vocabulary(name)), [t or "" for t in texts])


def check(rows, documents):
    tokenizer = load(vocabulary("byte_bpe_50k.json"))
    wanted = defaultdict(int)
    for doc_id, text in documents:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        n, start = len(ids), 0
        sizes = ([n % 2048] if n % 2048 else []) + [2048] * (n // 2048)
        for k, size in enumerate(sizes):
            wanted[doc_id, k, start, size, zlib.crc32(ids[start : start + size].tobytes())] += 1
            start += size
    got, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == wanted
    for members in bins.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= 2048
    return len(bins), sum(r.length for r in rows) / 2048


def test_edge_cases(spark, store, odd_documents):
    where = store(documents=odd_documents)
    check(op1_best_fit_packing(spark, where).collect(), [(r[0], r[1]) for r in odd_documents[0]])


def test_empty_table(spark, store, odd_documents):
    assert op1_best_fit_packing(spark, store(documents=([], odd_documents[1]))).count() == 0


def test_whole_table_is_packed_tightly(spark):
    where = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    sequences, least = check(op1_best_fit_packing(spark, where).collect(), docs.select("doc_id", "text").collect())
    assert sequences <= 1.01 * least + 1


def test_open_bins_stay_bounded_and_the_fullest_closes():
    bins, closed = packing.OpenBins(10, 2), []
    for i, size in enumerate([6, 7, 8, 2, 10, 3]):
        if members := bins.add(i, size):
            closed.append(members)
        assert bins.count <= 2
    assert closed == [[1], [2, 3], [4]]
    assert sorted(map(sorted, bins.rest())) == [[0, 5]]
