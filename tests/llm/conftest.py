import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators might use themselves
        T.StructField("n", T.StringType()),
        T.StructField("row_id", T.StringType()),
        T.StructField("shard", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def f(rows, partitions=2):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1] or ""), "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(partitions)

    return f


@pytest.fixture(scope="session")
def awkward(make):
    """Nulls, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, None, None, None),
        (2, "", "en", None),
        (3, " \n\t ", "en", "a"),
        (4, "one", "fr", "a"),
        (4, "one", "fr", "a"),
        (None, "a text without an id but with words", "en", "a"),
        (5, long, "en", "b"),
        (6, long, "en", "b"),
        (7, "ÄÖ ñ 日本 🙂 é̃", "de", "c"),
        (8, "!!! ... 123", None, "c"),
    ]
    return make(rows)
