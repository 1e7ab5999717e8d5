"""Differing rows against a count of rows on both sides."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from relayout.operators import drilldown as D


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, v double, a array<int>").repartition(3)


def key(row):
    return (row[0], row[1], row[2], tuple(row[3]) if row[3] is not None else None)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("range_rows", [1, 256])
def test_differing_rows(spark, monkeypatch, keys, range_rows):
    monkeypatch.setattr(D, "RANGE_ROWS", range_rows)
    one = [(i, "abc"[i % 3] if i % 7 else None, i / 3 if i % 5 else None, [i, None]) for i in range(900)]
    other = [row for row in one if row[0] not in (5, 100, 700)]  # dropped
    other += [one[8], one[8], (5, "c", 0.0, [5]), (-1, None, None, None), (-1, None, None, None)]  # more copies, changed, new
    found = D.differing_rows(table(spark, one), table(spark, other), keys).collect()
    left, right = Counter(map(key, one)), Counter(map(key, other))
    want = Counter({("source", *row): n for row, n in (left - right).items()})
    want += Counter({("target", *row): n for row, n in (right - left).items()})
    assert Counter({(r["side"], *key(r[2:])): r["copies"] for r in found}) == want and len(found) == len(want)


def test_equal_and_empty_tables(spark):
    rows = [(i, "a", 1.0, []) for i in range(20)]
    assert D.differing_rows(table(spark, rows), table(spark, rows[::-1]), ["k"]).count() == 0
    assert D.differing_rows(table(spark, []), table(spark, []), ["k"]).count() == 0
    found = D.differing_rows(table(spark, rows), table(spark, []), ["k"])
    assert found.agg(F.sum("copies")).first()[0] == 20 and found.select("side").distinct().collect() == [("source",)]


def test_other_schemas_are_refused(spark):
    with pytest.raises(ValueError, match="different schemas"):
        D.differing_rows(spark.range(1), spark.range(1).withColumnRenamed("id", "x"))
