from __future__ import annotations

import os

import duckdb
import public_tokenizers
import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def tokenizer():
    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="session")
def corpus():
    """``{doc_id: (text, lang, source)}`` of the smallest table."""
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{os.path.join(SF, 'documents.parquet')}'").fetchall()
    return {r[0]: r[1:] for r in rows}


def frame(spark, texts, sources=None):
    """Documents 1, 2, ... with the given texts."""
    rows = [(i + 1, t, "en", (sources or {}).get(i + 1, "s"), None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# Nulls in every column, empty and long texts, ties, repeated rows, and columns that clash by name.
LONG = ("Enr ea the thint password=abcdef1234567890 " * 4000).strip()
UGLY = [
    (1, "the same text of this and that one here", "en", "a", 39),
    (1, "the same text of this and that one here", "en", "a", 39),
    (2, "the same text of this and that one here", "en", "a", 39),
    (2, "another text that has the id of two", "en", None, 35),
    (3, None, None, None, None),
    (4, "", "en", "", 0),
    (5, " \n\t ", "en", "b", 4),
    (6, LONG, "en", "b", len(LONG)),
    (None, "a text that has no id at all", "en", "c", 28),
    (None, None, None, None, None),
    (7, "mit license", "de", "c", 11),
    (8, "ñandú ﬁ \U0001f600 token: 'abc.def-ghi' <|endoftext|> x y z", "es", "c", 50),
    (9, "!!! 123 ???", None, "c", 11),
]
CLASHING = ["size", "line", "kept", "label", "key", "node", "position", "score", "words", "_c0", "text_key", "TEXT"]


@pytest.fixture(scope="session")
def ugly(spark):
    rows = [(*r, *[str(i) for i in range(len(CLASHING))]) for r in UGLY]
    return spark.createDataFrame(rows, DOCS + ", " + ", ".join(f"`{c}` string" for c in CLASHING))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
