import pytest
from pyspark.sql import types as T

LONG = "ein langer text mit vielen worten " * 9_000
PASSAGE = " ".join(f"shared{i}" for i in range(30))
TOKEN = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'

#: doc_id, text, lang, source: nulls, empty and blank texts, ties, repeated rows, one long text, shared passages.
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, "one", "en", "a"), (5, "one", "en", "b"),
    (6, f"start here {PASSAGE} end", "en", "a"), (7, f"{PASSAGE} other {PASSAGE}", "de", "a"), (8, f"x{PASSAGE}", "en", None),
    (9, "a" * 400, "en", "a"), (10, "b" + "a" * 300, "en", "a"), (11, LONG, "de", "b"), (12, LONG + "Ende", "de", "b"),
    (13, "\u00c4rger \u2003 ni\u00f1o \U0001f600 " * 30, "es", "b"), (14, "tail\n" * 80, "en", "a"), (14, "tail\n" * 80, "en", "a"),
    (15, f"{TOKEN} {PASSAGE}", "en", "a"), (None, f"no id {PASSAGE}", "en", "a"), (16, f"{PASSAGE}", "en", "z"), (None, None, None, None),
]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "lang", "source")],
     T.StructField("n_chars", T.LongType())]
)
CLASHING = ("block", "row", "segment", "fp", "kept", "n_words", "size", "copies", "nr", "item_id", "rule", "host", "part")


@pytest.fixture(scope="session")
def odd_rows():
    return list(ODD)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clashing=False):
        df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)
        for name in CLASHING if clashing else ():
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def sample_rows(spark):
    got = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    return [tuple(r) for r in got.collect()]
