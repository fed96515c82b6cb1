from __future__ import annotations

import pytest
from pyspark.sql import functions as F

CLASHES = ("a", "g", "n", "s", "digest", "row", "score", "hash", "word", "item_id", "quality", "host", "kept", "u", "v", "locator", "size")


@pytest.fixture()
def docs(spark):
    """Build documents from (doc_id, text) rows, with further columns whose names the operators use themselves."""

    def build(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])

    return build


@pytest.fixture()
def pages(spark):
    def build(rows):
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        return df.select("*", *[F.lit("clash").alias(c) for c in ("path", "rule", "digest", "original", "size", "text", "n", "host", "id")])

    return build


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four five"), (6, "One two THREE four five"), (7, LONG), (8, LONG + " tail"), (9, "é " * 9), (9, "é " * 9), (None, "no id at all here ok"), (None, None)]


@pytest.fixture()
def odd(docs):
    return docs(ODD)
