import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from keystrand.llm import language_id as li
from keystrand.llm.queries import op6_language_id


def slow_tree(texts):
    counts = defaultdict(Counter)
    for t in texts:
        data = b"\n\n\n" + t.lower()
        for i in range(3, len(data)):
            for k in range(4):
                counts[data[i - k : i]][data[i]] += 1
    return counts


def slow_length(counts, text):
    data, bits = b"\n\n\n" + text.lower(), 0.0
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0):
            c = counts.get(data[i - k : i])
            if not c:
                continue
            total = sum(c.values()) + len(c)
            if data[i] in c:
                bits -= math.log2(c[data[i]] / total)
                break
            bits -= math.log2(len(c) / total)
        else:
            bits += 8
    return bits


def grams(texts):
    data, offsets = li.fold_texts(pa.array(texts, pa.binary()))
    return np.unique(li.contexts(data, offsets).astype(np.int64) << 8 | data, return_counts=True)


def test_code_lengths_equal_the_tree_walk():
    train = {"a": [b"the cat sat", b"a", b"the hat"], "b": ["père été".encode(), b"le pere"]}
    coder = li.Coder({k: grams(v) for k, v in train.items()})
    texts = ["the cat", "", "été", "zz\x00", "a", "THE père sat on"]
    lengths, sizes = coder.lengths(pa.array(texts))
    for text, row, size in zip(texts, lengths, sizes, strict=True):
        assert size == len(text.encode())
        for lang, got in zip(coder.languages, row, strict=True):
            assert abs(got / li.UNIT - slow_length(slow_tree(train[lang]), text.encode())) < 1e-3


def test_slices_of_a_column_and_nulls():
    whole = pa.array(["abc", None, "", "de"])
    data, offsets = li.fold_texts(whole.slice(1))
    assert bytes(data) == b"de" and offsets.tolist() == [0, 0, 0, 2]


def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.01"
    labels = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    rows = op6_language_id(spark, where).collect()
    assert {r.doc_id for r in rows} == set(labels) and len(rows) == len(labels)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == labels[r.doc_id][0] for r in held) / len(held) > 0.97


def test_every_labelled_language_is_learned(spark):
    """The documents of lowest hash until the bytes are reached, at least one, even if each is far longer than that."""
    rows = [(100 * g + k, f"l{g}", "abc " * 500) for g in range(12) for k in range(3)]
    rows += [(5000 + k, "many", "abcdefgh" * (5000 if k == 7 else 2)) for k in range(200)] + [(9000, "empty", ""), (9001, "few", "xyz")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = li.fit(docs, li.F.lit(True), 400)
    assert set(model) == {*(f"l{g}" for g in range(12)), "many", "few"}
    assert all(model[f"l{g}"][1].sum() == 2000 for g in range(12)) and model["few"][1].sum() == 3
    draws = {r.doc_id: r.d for r in docs.select("doc_id", li.F.expr("pmod(xxhash64(doc_id), 1000000)").alias("d")).collect()}
    total = 0
    for i, _, text in sorted((r for r in rows if r[1] == "many"), key=lambda r: draws[r[0]]):
        total += len(text)
        if total >= 400:
            break
    assert model["many"][1].sum() == total


def test_odd_rows(spark, store, odd_documents):
    rows, schema = odd_documents
    extra = [(100 + i, t, lang, "s", 1, "x", 7, "p", "w") for i, (t, lang) in enumerate([("123 ...", "en"), ("le chat était là", "fr"), ("der Hund und die Katze", "de")] * 4)]
    found = {r.doc_id: r for r in op6_language_id(spark, store(documents=([*rows, *extra], schema))).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 100)] == ["und"] * 4 and found[1].score == 0
    assert found[None].lang_pred in ("en", "fr", "de") and found[None].held_out is False


def test_nothing_learned_and_empty_table(spark, store, odd_documents, tmp_path):
    rows, schema = odd_documents
    where = store(documents=([(*r[:2], None, *r[3:]) for r in rows], schema))
    assert {r.lang_pred for r in op6_language_id(spark, where).collect()} == {"und"}
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert op6_language_id(spark, str(tmp_path / "none")).count() == 0
