import os
import sys

import pandas as pd
import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
for folder in (HERE, os.path.join(HERE, "..", "..")):
    sys.path.insert(0, os.path.abspath(folder))

#: Null and empty texts, ties, repeated rows, null ids and a column with a clashing name.
ODD = [
    (1, None, None, None, "x"), (2, "", "en", "", "x"), (3, "  \n ", "en", "a", "x"),
    (4, "Same text here", "en", "a", "x"), (5, "same TEXT here", "en", "a", "x"),
    (5, "same TEXT here", "en", "a", "x"), (None, "same text here", "en", None, "x"),
    (None, "alone without an id", None, None, "x"), (6, "ÄÖ äö", "de", "b", "x"),
    (7, "ÄÖ ÄÖ", "de", "b", "x"), (8, "word " * 30_000, "en", "b", "x"),
    (9, "y" * 200_000, None, "b", "x"), (10, "a b c d", "en", "c", "x"),
    (11, "a b c d", "en", "c", "x"), (12, "tab\tand\x0bline\x0cfeed\r\n\x00nul 🙂", "en", "c", "x"),
]
COLUMNS = "doc_id long, text string, lang string, source string, key string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def plain(sf_dir) -> pd.DataFrame:
    return pd.read_parquet(f"{sf_dir}/documents.parquet")
