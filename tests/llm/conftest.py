import datetime

import pytest


@pytest.fixture
def docs(spark):
    """A small documents table with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    base = "The quick brown fox jumps over the lazy dog near the river bank today"
    long_text = " ".join(f"word{i % 977} and{i % 31}" for i in range(6000))
    rows = [
        (1, base, "en", "a", 70),
        (2, base.upper(), "en", "a", 70),
        (3, base + " again", "en", "b", 76),
        (3, base + " again", "en", "b", 76),
        (4, None, None, None, None),
        (5, "", "en", "a", 0),
        (6, "   \n\t ", "en", "a", 6),
        (None, base, "en", "a", 70),
        (None, "only an unnamed row has this text", "en", "c", 33),
        (7, long_text, "en", "c", len(long_text)),
        (8, "Ä ä İ ß naïve ÉTÉ été", "fr", "c", 20),
        (9, "ä ä i̇ ß naïve été été", "fr", "c", 20),
        (10, "one", "en", "a", 3),
        (11, "one two", "en", "a", 7),
        (12, "ONE TWO", "en", "d", 7),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    return df.withColumns(
        {c: F.lit(datetime.date(2020, 1, 1)) for c in ("kept", "key", "shard", "mark", "length", "rank", "words", "score", "lines", "p")}
    )


@pytest.fixture
def saved(docs, tmp_path):
    """The folder of an input with that table and an empty one beside it."""
    docs.coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


@pytest.fixture
def nothing(docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)
