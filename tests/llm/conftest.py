import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from texts or (text, source) pairs, numbered from 0, or from whole tuples."""

    def make(rows, schema=DOCS):
        out = []
        for i, r in enumerate(rows):
            if r is None or isinstance(r, str):
                r = (i, r, "en", "s", len(r or ""))
            elif len(r) == 2:
                r = (i, r[0], "en", r[1], len(r[0] or ""))
            out.append(r)
        return spark.createDataFrame(out, schema)

    return make


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with names operators use."""
    schema = T.StructType.fromDDL(
        DOCS + ", size int, copies string, held_out string, score string, fp string, start int, n int, core int, kept string"
    )
    extra = (1, "c", "h", "s", "f", 2, 3, 4, "k")
    long = "word other thing " * 4000
    rows = [
        (0, None, None, None, None, *extra), (None, "some text here", None, "a", 14, *extra), (1, "", "en", "a", 0, *extra),
        (2, long, "en", "b", len(long), *extra), (3, "same row twice over", "de", None, 19, *extra),
        (3, "same row twice over", "de", None, 19, *extra), (4, "x", None, "a", 1, *[None] * 9),
        (5, "  \t\n ", "fr", "a", 5, *extra), (6, "é ß 漢字 \U0001F600 ñandú", "es", "b", 12, *extra),
    ]
    return spark.createDataFrame(rows, schema)
