"""Group comparison, guards, schema differences and the verdict."""

import re

import pytest
from pyspark.sql import functions as F

from relayout.operators import compare as C


@pytest.fixture(scope="module")
def rows(spark):
    key = F.when(F.col("id") % 5 != 0, F.col("id") % 5)
    return spark.range(1000).select("id", key.alias("k"), F.lit("x").alias("v"))


def changed(rows, condition, value="y"):
    return rows.withColumn("v", F.when(F.expr(condition), value).otherwise(F.col("v")))


def verdict(*args, **kwargs):
    return C.validate(*args, **kwargs).first()


def test_equal_with_null_keys(rows):
    found = verdict(rows, rows.repartition(3), ["k"])
    assert tuple(found) == (True, 1000, 1000, True, True, True, [])


def test_swapping_sides_keeps_the_verdict(rows):
    other = changed(rows, "id = 7")
    one, two = verdict(rows, other, ["k"]), verdict(other, rows, ["k"])
    assert (one["ok"], one["partition_ok"]) == (two["ok"], two["partition_ok"]) == (False, False)


def test_mismatch_is_found_in_its_group(rows):
    compared = C.compare_contents(rows, changed(rows, "id = 7"), ["k"])
    assert [row["k"] for row in C.mismatches(compared).collect()] == [2]


def test_null_group_differs(rows):
    compared = C.compare_contents(rows, changed(rows, "id = 5"), ["k"])
    assert [row["k"] for row in C.mismatches(compared).collect()] == [None]


def test_group_on_one_side_only(rows):
    compared = C.compare_contents(rows, rows.where("k <> 3 OR k IS NULL"), ["k"])
    row = C.mismatches(compared).first()
    assert (row["k"], row["source_row_count"], row["target_row_count"]) == (3, 200, None)


def test_row_moved_between_groups_is_equal_only_globally(spark):
    one = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b') AS t(k, v)")
    other = spark.sql("SELECT * FROM VALUES (1, 'b'), (2, 'a') AS t(k, v)")
    assert not verdict(one, other)["global_hash_ok"]
    assert C.mismatches(C.compare_contents(one, other, ["k"])).count() == 2


def test_examples_are_the_first_in_key_order(spark):
    one = spark.range(100).withColumn("v", F.lit(1))
    compared = C.compare_contents(one, one.withColumn("v", F.lit(2)), ["id"])
    assert [row["id"] for row in C.mismatch_examples(compared, ["id"]).collect()] == list(range(100))
    assert C.mismatch_examples(compared, ["id"], 7).count() == 7
    found = verdict(one, one.withColumn("v", F.lit(2)), ["id"])
    assert found["details"][0].startswith("groups that differ: 100, first 20: [")


def test_too_many_groups_are_refused(rows):
    found = verdict(rows, rows, ["id"], max_partitions=10)
    assert (found["ok"], found["global_hash_ok"], found["partition_ok"]) == (False, True, False)
    assert found["details"] == ["groups not judged: 1000 in source and 1000 in target, limit given 10"]


def test_missing_key_column(rows):
    found = verdict(rows, rows, ["K"])
    assert (found["ok"], found["partition_ok"]) == (False, False)
    assert found["details"] == ["no such partition column on both sides: K"]


def test_empty_tables_are_equal(rows):
    empty = rows.where("id < 0")
    assert tuple(verdict(empty, empty, ["k"])) == (True, 0, 0, True, True, True, [])
    assert tuple(verdict(empty, empty)) == (True, 0, 0, True, True, None, [])


def test_empty_against_filled(rows):
    found = verdict(rows.where("id < 0"), rows)
    assert re.fullmatch(
        r"contents differ: rows 0/1000; hash_a None/-?\d+; hash_b None/-?\d+", found["details"][0]
    )


def test_schema_differences(rows):
    found = verdict(rows, rows.withColumnRenamed("v", "w"))
    assert (found["ok"], found["schema_ok"], found["global_hash_ok"]) == (False, False, True)
    assert found["details"] == ["columns differ in name or order"]
    found = verdict(rows, rows.withColumn("id", F.col("id").cast("string")))
    assert found["details"] == ["type of id differs: bigint -> string"]
    assert verdict(rows, rows.withColumnRenamed("v", "V"))["ok"]


def test_retyped_key(rows):
    found = verdict(rows, rows.withColumn("k", F.col("k").cast("string")), ["k"])
    assert (found["schema_ok"], found["global_hash_ok"], found["partition_ok"]) == (False, True, True)


def test_different_number_of_columns(rows):
    found = verdict(rows, rows.drop("v"), ["k"])
    assert (found["schema_ok"], found["global_hash_ok"], found["partition_ok"]) == (False, False, False)


def test_one_scan_per_side(spark, tmp_path, rows):
    """Totals, guard, mismatches and examples all come from one scan of each table."""
    for name in ("one", "two"):
        rows.write.parquet(str(tmp_path / name))
    one, two = (spark.read.parquet(str(tmp_path / name)) for name in ("one", "two"))
    checked = C.validate(one, changed(two, "id = 7"), ["k"])
    checked.collect()
    plan = checked._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 0 and "SortMergeJoin" not in plan
    assert "ReusedExchange" in plan and "Expand" not in plan


def listed(spark, *rows):
    return spark.createDataFrame(list(rows), "table_name string, pos int, name string, dtype string")


def test_schema_verdicts(spark):
    source = listed(
        spark, ("same", 0, "A", "smallint"), ("same", 1, "b", "varchar(3)"),
        ("type", 0, "a", "int"), ("type", 1, "b", "int"), ("name", 0, "a", "int"),
        ("order", 0, "a", "int"), ("order", 1, "b", "int"), ("shorter", 0, "a", "int"),
        ("shorter", 1, "b", "int"),
    )
    target = listed(
        spark, ("same", 0, "a", "int"), ("same", 1, "B", "string"),
        ("type", 0, "a", "bigint"), ("type", 1, "b", "date"), ("name", 0, "c", "bigint"),
        ("order", 0, "b", "int"), ("order", 1, "a", "int"), ("shorter", 0, "a", "int"),
    )
    found = {
        row["table_name"]: (row["schema_ok"], row["details"])
        for row in C.schema_verdicts(C.schema_diff(source, target)).collect()
    }
    names = (False, ["columns differ in name or order"])
    assert found == {
        "same": (True, []),
        "type": (False, ["type of a differs: int -> bigint", "type of b differs: int -> date"]),
        "name": names,
        "order": names,
        "shorter": names,
    }
