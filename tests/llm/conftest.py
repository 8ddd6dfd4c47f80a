import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pytest  # noqa: E402

from tabular_audit.llm.common import ship  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [  # null, empty, blank, no letters, ties, repeated rows, odd characters
    (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n ", None, "a"), (4, "12 34 !!", "de", "b"),
    (5, "The cat sat on the mat.", "en", "b"), (5, "The cat sat on the mat.", "en", "b"),
    (6, "Die Katze saß auf der Matte, ÄÖÜ.", "de", "c"), (None, "no id here", "en", "c"),
    (7, "日本語 \U0001F600 x́ \x85 end<|endoftext|>tail", None, "d"), (8, "one", "en", None),
]


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with extra columns whose names clash with those used inside."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return rows.selectExpr("*", "1 AS id", "'x' AS size", "2 AS fp", "array(1) AS v", "'y' AS carried",
                           "3 AS bucket", "cast(null AS string) AS label")


@pytest.fixture(scope="session")
def long_text():
    return " ".join(f"word{i % 977} tail{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
