import pytest
from pyspark.sql import types as T

LONG = "lorem ipsum dolor " * 12_000

# null and repeated ids, null, empty, blank, letterless and very long texts, ties, repeated rows
ROWS = [
    (1, "one two three four five six seven", "en", "a"),
    (1, "one two three four five six seven", "en", "a"),
    (2, "one two three four five six seven", "en", None),
    (None, "one two three four five six seven", None, "b"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, " \t\n ", "fr", "c"),
    (6, "12 34 !?", "fr", "c"),
    (7, LONG, "fr", "c"),
    (8, LONG + "end", None, "c"),
    (9, "Größe ÉTÉ ñandú naïve", "de", "d"),
    (10, "two words", "de", "d"),
    (None, None, None, None),
]

_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    *[T.StructField(n, T.StringType()) for n in ("score", "size", "shard", "kept", "key", "a", "words", "_id", "_text")],
])


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents."""
    rows = [(*r, len(r[1] or ""), *["x"] * 9) for r in ROWS]
    return spark.createDataFrame(rows, _SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts(spark, sf):
    """The texts of the small table, by id."""
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
