import re
from collections import defaultdict

import numpy as np
import pytest
import corpus_pipeline
from test_line_dedup import slow as slow_lines
from test_packing import check as check_packing
from test_simhash_dedup import slow_components, slow_fingerprint
from test_substring_dedup import WORD
from test_substring_dedup import slow as slow_substrings

from keystrand.llm import common, pipeline


def steps(spark, docs, where):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.written(stage(spark, out[-1], where), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def check_stages(out):
    start, spoken, lined, single, cut, packed = out
    for df in out[1:-1]:
        assert df.columns == start.columns
    before, after = texts(start), texts(spoken)
    assert all(after[i] == before[i] for i in after)
    assert all(not re.search(r"[^\W\d_]", before[i] or "") for i in set(before) - set(after))
    wanted = {d: "\n".join(l for l, g in zip(lines, gone, strict=True) if not g) for d, lines, gone in slow_lines(list(after.items()))}
    assert texts(lined) == wanted and all(r.n_chars == len(r.text) for r in lined.collect())
    ids = sorted(wanted)
    least = defaultdict(list)
    for i, r in zip(ids, slow_components([slow_fingerprint(wanted[i]) for i in ids]), strict=True):
        least[r].append(i)
    kept = {i: wanted[i] for i in map(min, least.values())}
    assert texts(single) == kept
    for doc_id, words, gone in slow_substrings(list(kept.items()), 20):
        text = texts_cut[doc_id] if (texts_cut := texts_of(cut)) else None
        assert WORD.findall(text) == [w for w, g in zip(words, gone, strict=True) if not g]
        assert any(gone) or text == kept[doc_id]
    check_packing(packed.collect(), list(texts_of(cut).items()))


_seen = {}


def texts_of(df):
    if id(df) not in _seen:
        _seen[id(df)] = texts(df)
    return _seen[id(df)]


def test_stages_on_the_small_table(spark):
    where = "/root/testdata/sf0.001"
    check_stages(steps(spark, spark.read.parquet(f"{where}/documents.parquet"), where))


def test_run_equals_its_stages(spark, store):
    rows = [(i, t, "en" if i % 5 else None, "s", len(t or ""), i) for i, t in enumerate([None, "", "12 34", *[f"the story number {k} of a cat and a dog\nthe end" for k in range(20)]])]
    where = store(documents=(rows, "doc_id long, text string, lang string, source string, n_chars long, own int"))
    docs = spark.read.parquet(f"{where}/documents.parquet")
    key = lambda r: (r.doc_id, r.piece)
    a, b = sorted(corpus_pipeline.run(spark, where).collect(), key=key), sorted(steps(spark, docs, where)[-1].collect(), key=key)
    assert [(r.doc_id, r.piece, r.ids_crc32) for r in a] == [(r.doc_id, r.piece, r.ids_crc32) for r in b] and len(a) > 0
    kept = pipeline.identify_language(spark, docs, where).collect()
    assert {r.doc_id for r in kept} == set(range(3, 23)) and all(r.lang == "en" for r in kept)


def test_odd_rows_and_empty_table(spark, odd_documents):
    rows, schema = odd_documents
    for some in (rows, []):
        out = steps(spark, spark.createDataFrame(some, schema), "")
        assert all(df.columns == out[0].columns for df in out[:-1])
        assert (out[-1].count() > 0) == bool(some)


def test_rows_that_share_an_id(spark):
    """Each group of near copies keeps one row, whatever else has its id; different texts of an id all stay."""
    a, b, c = (" ".join(f"{w}{k}" for k in range(60)) for w in "abc")
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (2, c, "s"), (2, c, "s"), (3, b, "s"), (None, a, "s"), (None, a, "s")]
    found = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, digest string"), "")
    assert found.columns == ["doc_id", "text", "digest"]
    assert sorted(((r.doc_id or 0, r.text) for r in found.collect())) == sorted([(0, a), (0, a), (1, a), (2, b), (2, c)])


def test_clashing_columns_and_a_missing_label(spark):
    text = " ".join(f"w{k}" for k in range(60))
    names = ["__first", "__digest", "digest", "row", "fp", "a.b"]
    rows = spark.createDataFrame([(1, text, *names), (2, text, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    found = pipeline.drop_near_copies(spark, rows, "")
    assert found.columns == rows.columns and [tuple(r) for r in found.collect()] == [(1, text, *names)]
    with pytest.raises(ValueError):
        pipeline.identify_language(spark, rows, "")
