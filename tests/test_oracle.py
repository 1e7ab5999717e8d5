"""Every registered query against its plain SQL on the same files."""

import math
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import workload
from relayout.plans import migrate
from workload.fixtures import TABLES

QUERIES, ORACLE = workload.QUERIES, workload.ORACLE


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(row) for row in df.collect()])
    print(f"{name}: {time.time() - started:.1f}s, {len(got)} rows")
    answer = duck.execute(ORACLE[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, answer.fetchall())


CHECKED = (
    "rewrite_roundtrip", "compact_roundtrip", "snapshot_verdict", "inplace_roundtrip", "rollback_inplace",
    "publish_swap", "rollback_swap", "run_dry", "run_execute",
)


@pytest.mark.parametrize("name", CHECKED)
def test_a_comparison_that_always_agrees_is_noticed(spark, duck, sf_dir, name, monkeypatch):
    """Queries that rest on the comparison of tables must not pass without one."""
    real = migrate.validate

    def agreeing(*args, **kwargs):
        found = real(*args, **kwargs)
        fine = {column: F.lit(True) for column in ("ok", "schema_ok", "global_hash_ok", "partition_ok")}
        return found.withColumns(fine).withColumn("details", F.array().cast("array<string>"))

    monkeypatch.setattr(migrate, "validate", agreeing)
    df = QUERIES[name](spark, sf_dir)
    answer = duck.execute(ORACLE[name])
    columns = [c[0] for c in answer.description]
    assert rows_of(df.columns, [tuple(row) for row in df.collect()]) != rows_of(columns, answer.fetchall())
