import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from cliptide.session import ship_package  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


LONG = " ".join(f"w{k * k % 9973}" for k in range(20000))
ROWS = [
    (None, "one two three four five six seven", None, "a"),
    (1, None, "en", None),
    (2, "", "en", "a"),
    (3, " \n\t\n ", "en", "b"),
    (4, LONG, "en", "a"),
    (5, "Idiot! released under the MIT License.\nsecond line of five words here\nthird line of five words here", "en", "a"),
    (6, "other first line\nsecond line of five words here\nthird line of five words here", "en", "a"),
    (6, "other first line\nsecond line of five words here\nthird line of five words here", "en", "a"),
    (6, "another text under the same id", "de", "c"),
    (7, LONG, "en", "a"),
    (8, "é ü ß ñ " * 40, "de", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names operators use inside."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")
    clashing = ["id", "tie", "pos", "size", "row", "node", "token", "n", "runs", "copies", "taken", "target", "count", "copy_"]
    return rows.withColumns({c: F.lit(c) for c in clashing}).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
