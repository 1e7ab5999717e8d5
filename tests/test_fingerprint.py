"""Equality of fingerprints against equality of the rows themselves."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relayout.functions.canonical import canonical_rows
from relayout.functions.fingerprint import fingerprint, row_hashes, total_fingerprint
from relayout.operators.compare import TOTALS_MATCH, compare_contents, content_totals


def same(source, target, keys=()):
    totals = content_totals(compare_contents(source, target, keys))
    return totals.select(F.expr(TOTALS_MATCH)).first()[0]


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


NAN = float("nan")
MICRO = dt.datetime(2024, 1, 1, 0, 0, 0, 1)
MIDNIGHT = dt.datetime(2024, 1, 1)

DIFFERENT = {
    "null against blank": ("a string", (None,), ("",)),
    "null against marker": ("a string", (None,), ("<NULL>",)),
    "null against zero": ("a int", (None,), (0,)),
    "null moves to the next column": ("a int, b int", (None, 1), (1, None)),
    "text moves to the next column": ("a string, b string", ("a", "bc"), ("ab", "c")),
    "swapped columns": ("a int, b int", (1, 2), (2, 1)),
    "signed zero": ("a double", (0.0,), (-0.0,)),
    "signed zero in a float array": ("a array<float>", ([0.0],), ([-0.0],)),
    "null against nan": ("a double", (None,), (NAN,)),
    "scale is kept": ("a decimal(10,2)", (Decimal("1.00"),), (Decimal("1.01"),)),
    "microsecond": ("a timestamp", (MIDNIGHT,), (MICRO,)),
    "microsecond without zone": ("a timestamp_ntz", (MIDNIGHT,), (MICRO,)),
    "microsecond in a struct": ("a struct<t:timestamp>", ((MIDNIGHT,),), ((MICRO,),)),
    "microsecond in an array of structs": ("a array<struct<t:timestamp>>", ([(MIDNIGHT,)],), ([(MICRO,)],)),
    "microsecond in a map": ("a map<string,timestamp_ntz>", ({"k": MIDNIGHT},), ({"k": MICRO},)),
    "null struct against struct of null": ("a struct<x:int>", (None,), ((None,),)),
    "null moves inside a struct": ("a struct<x:int,y:int>", ((None, 1),), ((1, None),)),
    "null moves inside an array": ("a array<int>", ([None, 1],), ([1, None],)),
    "null at the end of an array": ("a array<int>", ([1],), ([1, None],)),
    "empty array against null": ("a array<int>", ([],), (None,)),
    "element moves to the next array": ("a array<int>, b array<int>", ([1], [2, 3]), ([1, 2], [3])),
    "nesting of arrays": ("a array<array<int>>", ([[1], [2]],), ([[1, 2]],)),
    "map value": ("a map<string,int>", ({"k": 1},), ({"k": 2},)),
    "map key": ("a map<string,int>", ({"k": 1},), ({"j": 1},)),
    "bytes": ("a binary", (b"\x00\xff",), (b"\x00\xfe",)),
    "boolean": ("a boolean", (True,), (False,)),
    "date": ("a date", (dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),)),
}

EQUAL = {
    "nan": ("a double", (NAN,), (NAN,)),
    "map entry order": ("a map<string,int>", ({"a": 1, "b": 2},), ({"b": 2, "a": 1},)),
    "map entry order inside an array": (
        "a array<map<string,struct<m:map<int,int>>>>",
        ([{"a": ({1: 1, 2: 2},), "b": None}],),
        ([{"b": None, "a": ({2: 2, 1: 1},)}],),
    ),
    "nulls": ("a int, s struct<x:int>, r array<string>, m map<int,int>", (None,) * 4, (None,) * 4),
}


@pytest.mark.parametrize("case", DIFFERENT)
def test_different_rows_differ(spark, case):
    schema, left, right = DIFFERENT[case]
    one, other = frame(spark, schema, left), frame(spark, schema, right)
    assert not same(one, other)
    assert same(one, one) and same(other, other)
    texts = [canonical_rows(df).first() for df in (one, other)]
    # Bytes that are no text cannot be told apart once they are Python strings.
    assert texts[0] != texts[1] or case == "bytes"


@pytest.mark.parametrize("case", EQUAL)
def test_equal_rows_agree(spark, case):
    schema, left, right = EQUAL[case]
    one, other = frame(spark, schema, left), frame(spark, schema, right)
    assert same(one, other)
    assert canonical_rows(one).first() == canonical_rows(other).first()


@pytest.mark.parametrize(
    "left, right, equal",
    [
        ("smallint", "int", True), ("tinyint", "int", True), ("int", "bigint", True),
        ("int", "string", True), ("double", "string", False), ("bigint", "double", False),
    ],
)
def test_types_are_compared_by_text_where_they_differ(spark, left, right, equal):
    values = spark.range(-3, 4)
    one = values.select(F.col("id").cast(left).alias("v"))
    other = values.select(F.col("id").cast(right).alias("v"))
    assert same(one, other) is equal


def test_column_names_cannot_be_mistaken(spark):
    rows = spark.sql("SELECT 1 AS `a.b`, named_struct('b', 2, 'c`d', 3) AS a, 4 AS `x``y`")
    changed = spark.sql("SELECT 1 AS `a.b`, named_struct('b', 5, 'c`d', 3) AS a, 4 AS `x``y`")
    assert same(rows, rows) and not same(rows, changed)
    aliased, other = rows.alias("a"), changed.alias("a")
    assert not same(aliased, other)
    assert canonical_rows(rows).columns == ["a.b", "a", "x`y"]


def test_order_and_partitioning_do_not_matter(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    assert same(rows, rows.orderBy(F.desc("id")).repartition(7), ["k"])


def test_multiplicity_matters(spark):
    rows = spark.range(10)
    assert not same(rows.union(rows.where("id = 1")), rows.union(rows.where("id = 2")))


def test_parts_add_up_to_the_whole(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    assert total_fingerprint(fingerprint(rows, ["k"])).first() == fingerprint(rows).first()


def test_sums_are_exact(spark):
    """The sums from 16-bit pieces are the plain sums of the signed hashes."""
    rows = spark.range(5000)
    hashes = row_hashes(rows).collect()
    found = fingerprint(rows).first()
    assert found["row_count"] == 5000
    assert found["hash_a"] == sum(row["hash_a"] for row in hashes)
    assert found["hash_b"] == sum(row["hash_b"] for row in hashes)


def test_empty_table(spark):
    found = fingerprint(spark.range(0)).first()
    assert tuple(found) == (0, None, None)
    assert tuple(total_fingerprint(fingerprint(spark.range(0), ["id"])).first()) == (0, None, None)


def test_more_columns_than_one_mask_holds(spark):
    names = [f"c{i}" for i in range(150)]
    rows = spark.range(3).select(*[F.lit(None).cast("int").alias(n) for n in names])
    for changed in ("c0", "c62", "c63", "c149"):
        assert not same(rows, rows.withColumn(changed, F.lit(0)))


def test_session_time_zone_with_a_gap(spark):
    """Local times that a zone skips are still two different values."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        one = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00' AS t")
        other = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 03:30:00' AS t")
        assert not same(one, other)
        assert canonical_rows(one).first() != canonical_rows(other).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


cells = st.tuples(
    st.one_of(st.none(), st.integers(-2, 2)),
    st.one_of(st.none(), st.sampled_from(["", "a", "null"])),
    st.one_of(st.none(), st.lists(st.one_of(st.none(), st.sampled_from([0.0, -0.0, 1.0])), max_size=2)),
)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(cells, max_size=4), st.lists(cells, max_size=4))
def test_verdict_is_multiset_equality(spark, left, right):
    schema = "a int, b string, c array<double>"
    one, other = frame(spark, schema, *left), frame(spark, schema, *right)
    assert same(one, other) == (sorted(map(repr, left)) == sorted(map(repr, right)))
