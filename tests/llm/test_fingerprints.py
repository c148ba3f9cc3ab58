import hashlib
import random

from keystrand.llm import fingerprints as fp
from keystrand.llm.queries import op10_document_fingerprints


def slow(text):
    own = fp.PrefixHash(text)
    return fp.printed(own.whole(), fp.sketch([own.windows()], own.whole()))


def check(rows, documents):
    order = sorted(documents, key=lambda d: (d[0] is not None, d[0] or 0), reverse=True)
    assert len(rows) == len(order)
    got = {r.doc_id: r for r in rows}
    for k, (doc_id, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1] or ""
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (slow(text), slow(edited))
        assert r.near_edited == fp.fingerprint_likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fp.fingerprint_likeness(r.fingerprint, slow(following))
        same = next((i for i, (a, b) in enumerate(zip(text, following, strict=False)) if a != b), min(len(text), len(following)))
        assert r.common_prefix == same


def test_whole_table(spark):
    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()
    rows = op10_document_fingerprints(spark, where).collect()
    check(rows, docs)
    assert sum(r.near_edited > r.near_next for r in rows if r.n_chars > 200) > 0.9 * sum(r.n_chars > 200 for r in rows)


def test_many_chunks(spark, monkeypatch):
    from keystrand.llm import common

    docs = spark.createDataFrame([(i * 7 % 101, "text %d %s" % (i % 9, "x" * i)) for i in range(101)], "doc_id long, text string")
    monkeypatch.setattr(fp, "ordered_chunks", lambda d: common.ordered_chunks(d, chunk_bytes=300))
    check(fp.fingerprint_edits(docs).collect(), [tuple(r) for r in docs.collect()])


def test_edge_cases(spark, store, odd_documents):
    rows, schema = odd_documents
    distinct = list(dict.fromkeys(rows))
    check(op10_document_fingerprints(spark, store(documents=(distinct, schema))).collect(), [(r[0], r[1]) for r in distinct])


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    assert fp.fingerprint_edits(docs).count() == 3
    assert fp.fingerprint_edits(docs.limit(0)).count() == 0


def test_spans_and_extensions():
    a, b = fp.PrefixHash("xxabcabcd"), fp.PrefixHash("abcabce")
    assert a.same(2, 8, b, 0) and not a.same(2, 9, b, 0)
    assert a.extension(2, b, 0) == 6 and a.extension(0, b, 0) == 0
    assert a.extension(5, b, 0) == 3


def test_only_equal_texts_have_likeness_one(spark):
    pick = random.Random(5)
    text = "".join(pick.choice("abcdefgh ") for _ in range(100_000))
    other = text[:50_000] + "#" + text[50_001:]
    docs = spark.createDataFrame([(4, text), (3, text), (2, other), (1, "a" * 90), (0, "a" * 91)], "doc_id long, text string")
    found = {r.doc_id: r for r in fp.fingerprint_edits(docs).collect()}
    assert found[4].near_next == 1.0 and 0.99 < found[3].near_next < 1.0 and found[1].near_next < 1.0
    assert len(found[4].fingerprint) == 16 + 8 * (100_000 // fp.EACH)


def test_error_of_the_estimate():
    pick, misses = random.Random(6), []
    for _ in range(40):
        a = "".join(pick.choice("abcdefgh ") for _ in range(20_000))
        b = "".join("#" if pick.random() < 0.01 else c for c in a)
        wa, wb = (set(fp.PrefixHash(x).windows().tolist()) for x in (a, b))
        j = len(wa & wb) / len(wa | wb)
        misses.append((fp.fingerprint_likeness(slow(a), slow(b)) - j) / (j * (1 - j) / (20_000 // fp.EACH)) ** 0.5)
    assert sum(x * x for x in misses) / len(misses) < 4


def test_the_lowest_id_there_is_and_null_ids(spark):
    rows = [(-(2**63), "lowest id"), (None, "no id"), (5, "five"), (None, None)]
    found = fp.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id is None), r.doc_id or 0) for r in found) == [(False, -(2**63)), (False, 5), (True, 0), (True, 0)]
    only = fp.fingerprint_edits(spark.createDataFrame(rows[1:2], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_chars) for r in only] == [(None, 5)]
