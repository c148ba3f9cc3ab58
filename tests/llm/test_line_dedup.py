import hashlib
import os
import random
import re

from keystrand.llm import line_dedup as ld
from keystrand.llm.queries import op5_line_dedup


def slow(documents):
    """[(doc_id, lines, removed flags)] of documents in order; a document per distinct (doc_id, text)."""
    out, sets = [], []
    for doc_id, text in sorted(set(documents), key=lambda d: (d[0] is not None, d[0] or 0)):
        lines = text.split("\n") if text is not None else None
        gone = []
        for line in lines or []:
            words = frozenset(w for w in re.split("[\x20\x09-\x0d]+", line) if w)
            gone.append(bool(words) and any(5 * len(words & s) >= 4 * len(words | s) for s in sets if 5 * min(len(s), len(words)) >= 4 * max(len(s), len(words))))
            sets.append(words)
        out.append((doc_id, lines, gone))
    return out


def check(rows, documents):
    wanted = {}
    for doc_id, lines, gone in slow(documents):
        kept = None if lines is None else hashlib.sha256("\n".join(l for l, g in zip(lines, gone, strict=True) if not g).encode()).hexdigest()
        wanted.setdefault(doc_id, set()).add((len(lines or []), sum(gone), kept))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.n_lines, r.n_removed, r.kept_sha256))
    assert got == wanted and len(rows) == len(documents)


def test_small_table(spark):
    where = "/root/testdata/sf0.001"
    check(op5_line_dedup(spark, where).collect(), [tuple(r) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()])


def test_near_copies_of_every_degree(spark):
    pick, docs = random.Random(11), []
    bases = [[pick.choice("abcdefghijklmnop") + str(pick.randrange(40)) for _ in range(pick.choice([1, 2, 4, 5, 9, 20, 40]))] for _ in range(12)]
    for k in range(150):
        lines = []
        for _ in range(4):
            line = list(pick.choice(bases))
            for _ in range(pick.randrange(6)):
                line[pick.randrange(len(line))] = pick.choice("abcdefghijklmnop") + str(pick.randrange(400))
            lines.append(" ".join(line))
        docs.append((k, "\n".join(lines)))
    found = ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    check(found.select("doc_id", "n_lines", "n_removed", ld.F.sha2("text", 256).alias("kept_sha256")).collect(), docs)


def test_odd_rows(spark, store, odd_documents):
    rows, schema = odd_documents
    check(op5_line_dedup(spark, store(documents=(rows, schema))).collect(), [(r[0], r[1]) for r in rows])


def test_empty_table(spark, store, odd_documents):
    assert op5_line_dedup(spark, store(documents=([], odd_documents[1]))).count() == 0


def test_no_python_in_the_plan(spark, store, odd_documents):
    plan = op5_line_dedup(spark, store(documents=odd_documents))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_shorter_line_posts_fewer_words(spark):
    words, docs = [f"w{k}" for k in range(180)], []
    for n in (9, 10, 45, 50, 90, 110, 144, 180):  # each pair of neighbours is at or about the least similarity, from either side
        docs += [(2 * n, " ".join(words[:n])), (1000 - n, " ".join(words[180 - n :] + ["end"]))]
    docs = [(d, t + "\n" + " ".join(t.split()[::-1][1:])) for d, t in docs]
    found = ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    check(found.select("doc_id", "n_lines", "n_removed", ld.F.sha2("text", 256).alias("kept_sha256")).collect(), docs)
    ranked = ld.ranked_lines(frame := spark.createDataFrame(docs, "doc_id long, text string"), ld.Names(frame)).withColumn("settled", ld.F.lit(False))
    posted = {side: dict(ld.searched(ranked, side).groupBy("line").count().collect()) for side in (True, False)}
    for line, n in ranked.select("line", "n").collect():
        assert posted[False][line] == n - -(-4 * n // 5) + 1 and posted[True][line] == n - -(-8 * n // 9) + 1


def test_fetched_words_are_deleted(spark, tmp_path, monkeypatch):
    made = []
    keep = ld.written
    monkeypatch.setattr(ld, "written", lambda df, name, *rest: made.append((name, keep(df, name, *rest))) or made[-1][1])
    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g")], "doc_id long, text string")
    assert [r.n_removed for r in ld.dedup_lines(rows).orderBy("doc_id").collect()] == [0, 1]
    paths = [f.rpartition("/")[0].removeprefix("file://") for name, df in made if name == "line-words" for f in df.inputFiles()]
    assert [name for name, _ in made].count("line-words") == 2 and paths and not any(os.path.exists(p) for p in paths)
