import pytest

LONG = "word " * 30_000
#: Empty, blank, very long, repeated and null texts, control strings, marks and other scripts.
TEXTS = [
    "", None, "   \n\t ", LONG, "a b c d e f", "a b c d e f", "<|startoftext|> J̌x \x00 a\x00b 1234",
    "Line one\nLine two\nLine one", "the quick brown fox " * 40, "éè 日本語 that's 's",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls everywhere, a repeated row, a null id and columns whose names clash with helpers."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s1", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id here", "en", "s1", 2), (3_000_000_000, "far id", "de", "s2", None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(rows, kinds)
    from pyspark.sql import functions as F

    clash = {c: F.lit("x") for c in ("part", "row", "base", "total", "ids", "n", "u", "rate", "copy", "token", "lines", "words", "score", "my col", "a.b", "back`tick")}
    return frame.withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
