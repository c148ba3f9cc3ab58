import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrand.llm import common, simple8b
from keystrand.llm.queries import op3_simple8b_token_files, vocabulary
from keystrand.llm.words import load


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=400), st.sampled_from([1, 7, 64, 512]))
def test_round_trip(ids, block):
    ids = np.array(ids, dtype=np.uint64)
    words, first, escaped = simple8b.encode(ids, block)
    assert (simple8b.decode(words, first, np.arange(0, len(ids), block), len(ids), escaped) == ids).all()


def test_a_block_decodes_alone():
    ids = np.arange(5000, dtype=np.uint64) ** 2
    words, first, escaped = simple8b.encode(ids, 512)
    own = simple8b.decode(words[first[3] : first[4]], np.array([0]), np.array([0]), 512, escaped)
    assert (own == ids[3 * 512 : 4 * 512]).all()


def test_word_counts():
    assert len(simple8b.encode(np.zeros(240, dtype=np.uint64), 512)[0]) == 2
    assert len(simple8b.encode(np.full(60, 32_767, dtype=np.uint64))[0]) == 15


def check(rows, documents):
    tokenizer, start = load(vocabulary("word_bpe_49k.json")), 0
    got = sorted(rows, key=lambda r: r.start)
    order = sorted(documents, key=lambda d: (d[0] is not None, d[0] or 0))
    assert [r.doc_id for r in got] == [d[0] for d in order]
    for r, (_, text) in zip(got, order, strict=True):
        raw = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(raw), zlib.crc32(raw.tobytes()))
        start += len(raw)


def test_whole_table(spark):
    where = "/root/testdata/sf0.01"
    check(op3_simple8b_token_files(spark, where).collect(), spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect())


def test_many_files_and_odd_rows(spark, store, odd_documents, monkeypatch):
    monkeypatch.setattr(simple8b, "ordered_chunks", lambda d: common.ordered_chunks(d, chunk_bytes=30))
    rows, schema = odd_documents
    check(op3_simple8b_token_files(spark, store(documents=(rows, schema))).collect(), [(r[0], r[1]) for r in rows])


def test_segments_with_escapes_join_in_one_file():
    writer, texts = simple8b.Writer(segment=700), [np.arange(k * 31, dtype="<u4") * 2_000_000_000 % 4_294_967_291 for k in range(60)]
    for k, ids in enumerate(texts):
        writer.add(None if k == 5 else k, ids.astype("<u4").tobytes())
    back = list(simple8b.read(writer.close()))
    assert [b[0] for b in back] == [None if k == 5 else k for k in range(60)]
    assert [b[2] for b in back] == [ids.astype("<u4").tobytes() for ids in texts]


def test_empty_table(spark, store, odd_documents):
    assert op3_simple8b_token_files(spark, store(documents=([], odd_documents[1]))).count() == 0


def test_an_altered_file_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    manifest = simple8b.write_token_files(docs, str(tmp_path / "t"), vocabulary("word_bpe_49k.json"), 1)
    path = manifest.first().path
    data = bytearray(simple8b.fetch(path))
    data[9] ^= 1
    simple8b.save(path, bytes(data))
    with pytest.raises(Exception, match="altered"):
        simple8b.read_token_files(manifest).collect()
