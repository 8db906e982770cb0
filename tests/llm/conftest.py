import pytest

ODD = [
    (1, "The same line of text, long enough to count here.\nshort\n", "en", "src0", 5, 1.5),
    (2, "The same line of text, long enough to count here.\nother words", "en", "src0", None, None),
    (2, "The same line of text, long enough to count here.\nother words", "en", "src0", None, None),
    (3, "  the SAME line of text, long enough to count here.\t", None, "src1", 7, 2.0),
    (4, "The same line of text, long enough to count here.", "de", None, 7, 2.0),
    (5, None, "en", "src1", 7, 2.0),
    (6, "", "en", "other", 7, 2.0),
    (7, " \n\t \n", "en", "other", 7, 2.0),
    (8, "é▁日本語 😀 \x00 end", "xx", "src2", 7, 2.0),
    (None, "The same line of text, long enough to count here.\nno id", "en", "src0", 7, 2.0),
    (9, "word " * 40_000, "en", "src2", 7, 2.0),
    (10, "x" * 200_000, "en", "src2", 7, 2.0),
]
#: ``row``, ``score`` and the like are also names that operators use inside.
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, `row` INT, score DOUBLE"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
