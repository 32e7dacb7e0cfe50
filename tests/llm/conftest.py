import pytest
from pyspark.sql import types as T

#: Names that the operators use inside; tables may have them too.
CLASHING = ("row", "hash", "key", "pos", "weight", "value", "count", "root", "print", "site", "cut")

KIND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in CLASHING),
    ]
)

PROSE = (
    "The harbour wakes before the town does. Boats come in with the tide and leave "
    "again with it, whatever the hour. Nobody keeps a list of who went out. "
    "A lamp on the mole is lit every night by the same hand."
)


@pytest.fixture(autouse=True)
def shared_folder(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def table(spark):
    """Documents from ``(id, text)`` or ``(id, text, lang, source)`` tuples."""

    def build(rows):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, *("en", "a")[len(r) - 2 :])[:4]
            size = None if text is None else len(text)
            full.append((doc_id, text, lang, source, size, *("x" for _ in CLASHING)))
        return spark.createDataFrame(full, KIND)

    return build


@pytest.fixture
def odd(table):
    """Nulls, empty and long texts, repeated rows, one id with two texts."""
    long_text = "\n".join(f"Line {k} of {k % 97} goes on. And on it goes {k}." for k in range(20_000))
    return table(
        [
            (1, PROSE),
            (1, PROSE),
            (1, PROSE + " More of it."),
            (2, None),
            (3, ""),
            (4, " \t\n "),
            (5, long_text),
            (None, PROSE, None, None),
            (None, None, None, None),
            (6, PROSE, None, "b"),
            (7, "one"),
        ]
    )
