import pytest


@pytest.fixture
def store(spark, tmp_path):
    """A folder of tables: store(documents=rows) writes them and returns the folder."""

    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


DOCS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket int, piece string, word string"


@pytest.fixture
def odd_documents():
    """Null, empty and blank texts, a long one, ties, repeated rows, null ids and clashing extra columns."""
    long = " ".join(f"w{i % 700} and" for i in range(9000))
    texts = {1: None, 2: "", 3: " \n\t ", 4: "one", 5: "The cat sat.\nThe dog ran.", 6: "The cat sat.\nThe dog ran.", 7: long, 8: long + " end", 9: "é" * 300, 10: "<|endoftext|> a  b"}
    rows = [(i, t, None if i % 4 == 0 else "en", "s", 1, "x", 7, "p", "w") for i, t in texts.items()]
    return [*rows, rows[4], (None, "no id", None, None, None, None, None, None, None)], DOCS
