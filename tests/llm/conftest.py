import pytest
from pyspark.sql import types as T

from cohortspan.llm.common import prepare

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that the operators use themselves
    + [T.StructField(n, T.StringType()) for n in ("fp", "key", "order", "size", "_row", "place", "id", "row", "site", "before", "found")]
)
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix potions near rivers".split()
LONG = " ".join(WORDS[i * 7 % len(WORDS)] + str(i % 97) for i in range(30_000))

#: Null ids, null and empty texts, white space only, a very long text, repeated rows, ties, odd characters.
ODD = [
    (5, None, None, None, None), (6, "", "en", "a", 0), (7, " \t\n ", "en", "a", 4), (None, "no id here at all", "en", "b", 17),
    (None, "no id here at all", "en", "b", 17), (8, LONG, "en", "a", len(LONG)), (9, "same row twice\nsame row twice", "en", "", 5),
    (9, "same row twice\nsame row twice", "en", "", 5), (9, "another text, same id", "de", None, 5), (10, "été 😀 naïve ÜBER x y", "fr", "c", 3),
    (11, "12345 !!! ---", None, "c", 3), (2**60, "big id", "de", "c", None),
]


def rows_of(rows):
    return [(*r, *["x"] * (len(SCHEMA) - 5)) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return prepare(spark).createDataFrame(rows_of(ODD), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return prepare(spark).createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return prepare(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def corpus(docs):
    """(doc_id, text, lang, source) of the smallest table."""
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.orderBy("doc_id").collect()]


def make(spark, rows):
    """Documents from (doc_id, text[, lang[, source]])."""
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
