import os
import random

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

# names that the operators use inside
CLASHING = ("row", "hash", "n", "sid", "set", "words", "score", "owner", "content", "length", "start", "ids", "label",
            "component_id", "payload", "key", "anchor", "spans")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"{name} string" for name in CLASHING
)


def rows_of(texts, first=1):
    """Rows with clashing extra columns; a text may come as (id, text)."""
    out = []
    for i, text in enumerate(texts):
        doc_id, body = text if isinstance(text, tuple) else (first + i, text)
        size = None if body is None else len(body)
        out.append((doc_id, body, "en", f"src{i % 5}", size, *["x"] * len(CLASHING)))
    return out


@pytest.fixture(scope="session")
def frame(spark):
    def make(texts, first=1):
        return spark.createDataFrame(rows_of(texts, first), SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, signs, very long, repeated rows, rows of one id, a null id."""
    seed = random.Random(5)
    long = " ".join(seed.choice("abcdefgh") * seed.randint(1, 9) for _ in range(60_000))
    same = "the same words in the same row, again and again " * 9
    return [
        None, "", " \t\n", "word", "..?!", long, same, same, (8, same), (90, "one id " * 30), (90, "one id, other text"),
        (None, "no id at all but a text " * 8), (None, None), "é" * 300, "a" * 5000, "x\x00y z " * 40,
    ]


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels", "conversations", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.fixture(scope="session")
def documents(duck):
    return duck.execute("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()


def collected(df):
    return [tuple(row) for row in df.collect()]
