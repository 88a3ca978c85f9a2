import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, repeated rows and a clashing extra column."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some text of no id at all", "en", "s", 5), (4, "a" * 20_000, "en", "s", 20_000), (5, "the same row twice", "en", "s", 3)]
    rows += [(5, "the same row twice", "en", "s", 3), (6, "word " * 30_000, "en", "s", 9), (7, "\x1c\x00é三😀 \t\n", "en", None, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({"id": F.lit("clash"), "score": F.lit("clash"), "n_words": F.lit("clash"), "found": F.lit(1)})
