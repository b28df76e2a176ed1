import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (id, text) rows, with columns whose names could clash with work columns."""

    def make(rows):
        extra = [(i, t, "en", "src", None if t is None else len(t), 1, "x", -1) for i, t in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, line int, name string, block long"
        return spark.createDataFrame(extra, schema)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def text_of(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
