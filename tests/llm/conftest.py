from __future__ import annotations

import pandas as pd
import pytest

FOLDER = "/root/testdata/sf0.001"

#: Nulls, empty and long texts, ties, repeated rows, and columns with names that operators use inside.
ODD = [
    (1, "", "x"), (2, None, "x"), (None, "a b c d e f g", "x"), (3, "word " * 3000, "x"), (3, "word " * 3000, "x"),
    (4, "Same text in two rows, and once more.", "y"), (4, "another text of that id", "y"), (5, "Same text in two rows, and once more.", None),
]


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def texts():
    rows = pd.read_parquet(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).sort_values("doc_id")
    return {d: t or "" for d, t in zip(rows.doc_id.tolist(), rows.text)}


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(
        [(*r, 7, 0, "k", 1, 2, 3, "s") for r in ODD],
        "doc_id long, text string, node string, row int, start int, value string, _gone long, _hash long, _id long, spans string",
    )


@pytest.fixture
def empty(odd):
    return odd.filter("false")
