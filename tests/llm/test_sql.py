"""Registered queries against their SQL, and the same on odd rows."""

import duckdb
import pyarrow as pa
import pytest

from relayout.llm import queries
from relayout.llm.oracle import SQL

from .conftest import SF


def plain(rows):
    return sorted((tuple(f"{v:.9g}" if isinstance(v, float) else v for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_given_tables(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert plain(tuple(row) for row in df.select(columns).collect()) == plain(want)


@pytest.mark.parametrize("name", ["op4_decontamination", "op5_quality_rules", "op7_secret_scan"])
@pytest.mark.parametrize("which", ["odd", "empty"])
def test_odd_rows(spark, frame, odd_texts, tmp_path, name, which):
    items = [(1, "one id " * 10), (2, None), (None, "the same words in the same row"), (4, ""), (5, "word"), (5, "word")]
    secrets = [
        'token = "abcdefghijkl0123"', "AKIA" + "A1" * 9 + " x", "0123456789abcdef0 Passwd: 'abc'", "A1b2" * 8,
        "password: token: abcdefghijklmnop", "api_key=" + "deadbeef" * 3, "é token=abcdefghijkl=1 AKIAAKIA00",
    ]
    texts = (odd_texts + secrets) if which == "odd" else []
    docs = frame(texts).where("doc_id IS NOT NULL OR text IS NOT NULL" if name == "op4_decontamination" else "true")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.createDataFrame(items if which == "odd" else [], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.register(table, pa.table(spark.read.parquet(f"{tmp_path}/{table}.parquet").toArrow()))
    df = queries.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    got = plain(tuple(row) for row in df.select(columns).collect())
    if name == "op4_decontamination":  # rows of one id count together; here only the pairs are compared
        pick = [columns.index("doc_id"), columns.index("item_id")]
        got, want = ({tuple(row[i] for i in pick) for row in rows} for rows in (got, want))
        assert got == want
    else:
        assert got == plain(want)
    assert bool(texts) == bool(got)
