import hashlib
import re

import numpy as np

from keystrand.llm import substring_dedup as sd
from keystrand.llm.queries import op2_substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(documents, width):
    """[(doc_id, words, removed flags)] in order."""
    seen, out = set(), []
    for doc_id, text in sorted(documents, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        out.append((doc_id, words, gone))
    return out


def check_query(rows, documents):
    wanted = []
    for doc_id, words, gone in slow(documents, 20):
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        wanted.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, rows), key=key) == sorted(wanted, key=key)


def test_whole_table(spark):
    where = "/root/testdata/sf0.01"
    rows = op2_substring_dedup(spark, where).collect()
    check_query(rows, [tuple(r) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()])
    assert sum(r.n_removed > 0 for r in rows) > 50


def test_odd_rows(spark, store, odd_documents):
    rows, schema = odd_documents
    rows = [r for r in rows if r[0] != 5]  # a repeated pair and two equal texts stay
    check_query(op2_substring_dedup(spark, store(documents=([*rows, rows[5], rows[6]], schema))).collect(), [(r[0], r[1]) for r in [*rows, rows[5], rows[6]]])


def test_empty_table(spark, store, odd_documents):
    assert op2_substring_dedup(spark, store(documents=([], odd_documents[1]))).count() == 0


def test_many_chunks_spans_and_carried_columns(spark):
    pick = np.random.default_rng(3)
    texts = [" ".join(str(x) for x in pick.integers(0, 3, pick.integers(0, 60))) for _ in range(120)]
    docs = [(i * 31 % 120, t, f"s{i}") for i, t in enumerate(texts)]
    found = sd.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string, chunk string"), width=6, carry=("chunk",), chunk_bytes=400)
    got = {r.doc_id: r for r in found.collect()}
    source = {d: s for d, _, s in docs}
    for doc_id, words, gone in slow([d[:2] for d in docs], 6):
        r = got[doc_id]
        flags = [False] * len(words)
        for a, b in r.removed:
            assert not any(flags[max(0, a - 1) : b])  # maximal and disjoint
            flags[a:b] = [True] * (b - a)
        assert flags == gone and r.n_removed == sum(gone) and r.chunk == source[doc_id]


def test_cut_keeps_white_space():
    flags = np.array([0, 1, 1, 0, 0, 1], dtype=bool)
    assert sd.cut(b" a\nb c  d\te f ", flags, True) == b" a\nd\te "
    assert sd.cut(b" a\nb c  d\te f ", flags, False) == b"a d e"
    assert sd.cut(b" a\n", np.zeros(1, dtype=bool), True) == b" a\n"


def test_hash_coding():
    values = np.unique(np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64))
    for n in (1, 2, 500):
        assert (sd.unpacked_hashes(sd.packed_hashes(values[:n])) == values[:n]).all()
    wide = np.array([0, 2**64 - 1], dtype=np.uint64)
    assert (sd.unpacked_hashes(sd.packed_hashes(wide)) == wide).all()


def test_rows_that_share_an_id_go_by_a_hash_of_the_text(spark):
    """Whatever the order of the rows and however their texts compress, the same one of two rows of an id comes first."""
    shared = " ".join(f"w{i}" for i in range(20))
    texts = [f"{shared} zz", f"y {shared}", f"{shared} " + "q " * 300]
    found = set()
    for order in (texts, texts[::-1]):
        rows = sd.dedup_substrings(spark.createDataFrame([(7, t) for t in order], "doc_id long, text string")).collect()
        found.add(frozenset((r.n_words, r.n_removed) for r in rows))
        assert sorted(r.n_removed > 0 for r in rows) == [False, True, True]
    assert len(found) == 1
