import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, label string, score double, size int"
LONG = " ".join(f"word{i % 5000}x" for i in range(30_000))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with names that the operators use."""
    texts = [None, "", "  \n\t ", "hello", "Hello hello hello", "a b c d e f g h " * 12, "a b c d e f g h " * 12, LONG, LONG + " tail", "Größe ça İ 漢字 \x00 !!", "x " * 60]
    rows = [(k, t, None if k % 3 == 0 else "en", None, None if t is None else len(t), "l", 0.5, k) for k, t in enumerate(texts)]
    rows += [rows[5], rows[7], (None, "no id here", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
