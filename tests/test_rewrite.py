"""Casts, layouts, rewrites and compaction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from relayout.operators import rewrite as R
from relayout.plans.migrate import compact_table, same_columns, validate_tables
from relayout.sources.catalog import describe_table, table_exists


def files_of(spark, table):
    return spark.table(table).select(F.input_file_name().alias("f")).distinct().count()


def test_cast_projection(spark):
    df = spark.sql("SELECT CAST(1 AS SMALLINT) AS a, 2 AS b")
    assert R.cast_projection(df, {"a": "int", "b": "string"}).dtypes == [("a", "int"), ("b", "string")]
    with pytest.raises(ValueError, match=r"that the table lacks: \['x', 'y'\]"):
        R.cast_projection(df, {"y": "int", "x": "int"})


def test_layout_values(spark):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ '1969-12-31 23:30:00' AS t, -7 AS n, CAST(NULL AS INT) AS z, 'héllo' AS s"
    )
    spec = ["years(t)", "months(t)", "days(t)", "hours(t)", "truncate(5,n)", "truncate(2,s)",
            "bucket(8,n)", "bucket(8,z)", "n"]
    laid_out, names, derived = R.with_layout(df, spec)
    row = laid_out.first()
    assert [row[name] for name in names[:6]] == [-1, -1, -1, -1, -10, "hé"]
    assert 0 <= row["n_bucket_8"] < 8 and 0 <= row["z_bucket_8"] < 8
    assert names[-1] == "n" and "n" not in derived


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_layout_does_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql(
            "SELECT timestamp_seconds(-1) AS i, TIMESTAMP_NTZ '1970-01-01 02:30:00' AS l"
        )
        spec = [f"{part}({name})" for name in "il" for part in ("years", "months", "days", "hours")]
        laid_out, names, _ = R.with_layout(df, spec)
        assert tuple(laid_out.select(*names).first()) == (-1, -1, -1, -1, 0, 0, 0, 2)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_layout_of_dates(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),)], "d date")
    row = R.with_layout(df, ["years(d)", "months(d)", "days(d)"])[0].first()
    assert tuple(row)[1:] == (54, 649, 19782)


def test_layout_needs_known_columns(spark):
    with pytest.raises(ValueError, match="not in the table: 'x'"):
        R.with_layout(spark.range(1), ["x"])
    taken = spark.range(1).withColumn("id_bucket_4", F.lit(1))
    with pytest.raises(ValueError, match="already exists"):
        R.with_layout(taken, ["bucket(4,id)"])


def test_rewrite_keeps_content_and_order(spark, database):
    source, target = f"{database}.t", f"{database}.t__ice"
    spark.range(1000).select(
        (F.col("id") % 3).cast("string").alias("k"), "id", F.lit(None).cast("string").alias("n")
    ).write.saveAsTable(source)
    derived = R.rewrite_table(spark, source, target, ["k", "bucket(4,id)", "n"], location="")
    assert derived == ["id_bucket_4"]
    assert spark.table(target).columns == ["id", "k", "id_bucket_4", "n"]
    assert validate_tables(spark, source, target, ["k"], derived=derived)["ok"]
    assert not validate_tables(spark, source, target, ["k"])["schema_ok"]
    with pytest.raises(RuntimeError, match="not overwritten"):
        R.rewrite_table(spark, source, target)


def test_blank_partition_value_is_caught(spark, database):
    """File tables cannot tell a blank partition value from NULL; the comparison sees the loss."""
    spark.sql(f"CREATE TABLE {database}.t USING parquet AS SELECT 1 AS a, '' AS k")
    R.rewrite_table(spark, f"{database}.t", f"{database}.u", ["k"])
    found = validate_tables(spark, f"{database}.t", f"{database}.u", ["k"], derived=[])
    assert (found["ok"], found["global_hash_ok"], found["partition_ok"]) == (False, False, False)


def test_rewrite_to_a_location_and_format(spark, database, tmp_path):
    spark.range(10).write.saveAsTable(f"{database}.t")
    R.rewrite_table(spark, f"{database}.t", f"{database}.u", location=f"{tmp_path}/u", fmt="orc")
    row = describe_table(spark, f"{database}.u")
    assert (row["type_raw"], row["provider"]) == ("EXTERNAL", "orc")
    assert validate_tables(spark, f"{database}.t", f"{database}.u")["ok"]


def test_hot_partition_is_cut(spark, database):
    """One value holds nearly all rows and still becomes several files."""
    spark.range(0, 400_000, 1, 8).select(
        F.when(F.col("id") % 50 == 0, F.col("id") % 3).otherwise(7).alias("k"),
        "id",
        F.sha2(F.col("id").cast("string"), 256).alias("text"),
    ).write.saveAsTable(f"{database}.t")
    R.rewrite_table(spark, f"{database}.t", f"{database}.u", ["k"], target_file_bytes=4 << 20)
    hot = spark.table(f"{database}.u").where("k = 7").select(F.input_file_name()).distinct().count()
    rare = spark.table(f"{database}.u").where("k = 1").select(F.input_file_name()).distinct().count()
    assert hot >= 4 > rare
    assert validate_tables(spark, f"{database}.t", f"{database}.u", ["k"], derived=[])["ok"]


def test_no_shuffle_without_partitions(spark):
    assert R.clustered(spark.range(10), []) .sameSemantics(spark.range(10))
    plan = R.clustered(spark.range(10), ["id"], 10 << 20, 1 << 20)._jdf.queryExecution().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan and "hashpartitioning(id" in plan and ", 10)" in plan


def test_no_shuffle_where_the_source_is_stored_by_partition(spark, database):
    """Two files per partition stay two: a shuffle would have joined them."""
    rows = spark.range(0, 100, 1, 2).select("id", (F.col("id") % 3).alias("k"))
    rows.write.partitionBy("k").saveAsTable(f"{database}.t")
    R.rewrite_table(spark, f"{database}.t", f"{database}.u", ["K"], small_files=True)
    R.rewrite_table(spark, f"{database}.t", f"{database}.v", ["K"], small_files=False)
    assert files_of(spark, f"{database}.t") == 6
    assert files_of(spark, f"{database}.u") == 3
    assert files_of(spark, f"{database}.v") in (3, 6)
    assert validate_tables(spark, f"{database}.t", f"{database}.v", ["k"], derived=[])["ok"]


@pytest.mark.parametrize(
    "keys, derived, stored_by, kept",
    [
        (["a"], [], ["A", "b"], True), ([], [], [], True), (["a", "b"], [], ["a"], False),
        (["a_days"], ["a_days"], ["a_days"], False),
    ],
)
def test_keeps_partitions(keys, derived, stored_by, kept):
    assert R.keeps_partitions(keys, derived, stored_by) is kept


def test_settings_are_restored(spark, database):
    watched = [*R._write_settings(1), *R._packing_settings(1, 1)]
    before = {key: spark.conf.get(key, None) for key in watched}
    spark.range(10).write.saveAsTable(f"{database}.t")
    compact_table(spark, f"{database}.t")
    assert {key: spark.conf.get(key, None) for key in watched} == before


def paths_of(spark, table, where="true"):
    return {r[0] for r in spark.table(table).where(where).select(F.input_file_name()).distinct().collect()}


def test_partitioned_writes_hold_no_sorted_rows(spark, database):
    spark.sql(f"CREATE TABLE {database}.t (a BIGINT, k INT) USING parquet PARTITIONED BY (k)")
    with R.sql_settings(spark, R._write_settings(R.TARGET_FILE_BYTES)):
        plan = spark.sql(f"EXPLAIN INSERT INTO {database}.t SELECT id, CAST(id % 3 AS INT) FROM range(9)").first()[0]
        assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) > 3
    assert "InsertIntoHadoopFsRelationCommand" in plan and "Sort" not in plan


def test_more_partitions_than_open_files(spark, database):
    rows = spark.range(0, 5000, 1, 2).selectExpr("id", "CASE WHEN id % 40 > 0 THEN CAST(id % 40 AS INT) END AS k")
    rows.write.saveAsTable(f"{database}.many")
    R.rewrite_table(spark, f"{database}.many", f"{database}.split", ["k"])
    copy = spark.table(f"{database}.split").select("id", "k")
    assert copy.count() == 5000 and copy.exceptAll(rows).isEmpty()


def test_compaction(spark, database):
    table = f"{database}.t"
    spark.sql(
        f"CREATE TABLE {table} (id BIGINT, code CHAR(4)) USING parquet COMMENT 'it''s ours' TBLPROPERTIES ('owner_team' = 'a\\\\b')"
    )
    spark.range(0, 1000, 1, 20).select("id", F.lit("ab")).write.insertInto(table)
    before, was = paths_of(spark, table), describe_table(spark, table)
    assert len(before) == 20
    assert compact_table(spark, table)["ok"]
    assert files_of(spark, table) == 1 and spark.table(table).selectExpr("sum(id)").first()[0] == 499500
    now = describe_table(spark, table)
    assert {**now, "location": ""} == {**was, "location": ""} and "owner_team" in now["table_properties"]
    kept = [t["tableName"] for t in spark.sql(f"SHOW TABLES IN {database}").collect() if "precompact" in t["tableName"]]
    assert len(kept) == 1 and spark.table(f"{database}.{kept[0]}").count() == 1000  # for a way back
    again = compact_table(spark, table)
    assert again["ok"] and again["compacted"] == 0
    spark.range(0, 10, 1, 5).select("id", F.lit("ab")).write.insertInto(table)
    assert compact_table(spark, table)["compacted"] == 1 and spark.table(table).count() == 1010


def test_compaction_of_a_partitioned_table(spark, database, tmp_path):
    """Only scattered partitions are written again; values that need escaping and NULL are partitions like others."""
    table = f"{database}.t"
    rows = spark.range(0, 1000, 1, 10).selectExpr(
        "id", "CASE id % 3 WHEN 0 THEN 'a=/\\' é' WHEN 1 THEN 'b' END AS k", "DATE '2024-01-01' AS d"
    )
    rows.write.partitionBy("k", "d").option("path", f"{tmp_path}/t").saveAsTable(table)
    one = spark.range(5).selectExpr("id", "'good' AS k", "DATE '2024-01-02' AS d").coalesce(1)
    one.write.insertInto(table)
    good = paths_of(spark, table, "k = 'good'")
    assert files_of(spark, table) == 31 and len(good) == 1
    found = compact_table(spark, table)
    assert (found["ok"], found["partition_ok"], found["compacted"], found["source_rows"]) == (True, True, 3, 1000)
    assert files_of(spark, table) == 4 and paths_of(spark, table, "k = 'good'") == good
    assert spark.table(table).where("k IS NULL").count() == 333 and spark.table(table).count() == 1005
    row = describe_table(spark, table)
    assert row["type_raw"] == "EXTERNAL" and row["location"].endswith("/t")
    assert compact_table(spark, table)["compacted"] == 0


def test_compaction_that_loses_a_row_switches_nothing(spark, database, monkeypatch):
    table = f"{database}.t"
    spark.range(0, 100, 1, 4).withColumn("k", F.lit(1)).write.partitionBy("k").saveAsTable(table)
    before = paths_of(spark, table)
    batches = R.partition_batches
    monkeypatch.setattr(R, "partition_batches", lambda *a: (b.where("id <> 7") for b in batches(*a)))
    with pytest.raises(RuntimeError, match="contents differ"):
        compact_table(spark, table)
    assert paths_of(spark, table) == before


def test_compaction_refuses_what_it_would_break(spark, database):
    spark.range(10).write.format("json").saveAsTable(f"{database}.j")
    spark.range(10).write.bucketBy(2, "id").saveAsTable(f"{database}.b")
    for table, why in (("j", "stored as json"), ("b", "bucketed")):
        with pytest.raises(ValueError, match=why):
            compact_table(spark, f"{database}.{table}")


def test_small_files_without_partitions_are_packed(spark, database):
    spark.range(0, 400, 1, 40).write.saveAsTable(f"{database}.t")
    for i, small in enumerate((True, False)):
        R.rewrite_table(spark, f"{database}.t", f"{database}.u{i}", small_files=small)
        assert files_of(spark, f"{database}.u{i}") == 1


def test_truncated_values(spark):
    df = spark.sql(
        "SELECT CAST(10.65 AS DECIMAL(9,2)) AS d, CAST(-10.65 AS DECIMAL(9,2)) AS m, CAST(-128 AS TINYINT) AS t,"
        " CAST(-7 AS SMALLINT) AS s, -9223372036854775808L + 3 AS l, X'010203' AS b, 1.5D AS f, CAST(NULL AS INT) AS z"
    )
    spec = ["truncate(50,d)", "truncate(50,m)", "truncate(200,t)", "truncate(10,s)", "truncate(3,l)", "truncate(2,b)",
            "truncate(4,z)"]
    laid_out, names, _ = R.with_layout(df, spec)
    row = laid_out.select(*names).first()
    assert [str(v) if i < 2 else v for i, v in enumerate(row)] == [
        "10.50", "-11.00", -200, -10, -9223372036854775806, bytearray(b"\x01\x02"), None,
    ]
    with pytest.raises(ValueError, match="not defined for double"):
        R.with_layout(df, ["truncate(2,f)"])


def test_same_columns_only_for_the_same_columns(spark):
    one, other = spark.sql("SELECT 1 AS a, 2 AS b"), spark.sql("SELECT 2 AS B, 1 AS a, 3 AS c")
    assert same_columns(one, other, ["c"]).columns == ["a", "b"]
    assert same_columns(one, other, []).columns == ["B", "a", "c"]


def test_rows_out_of_sight(spark, database, tmp_path):
    spark.range(10).withColumn("k", F.lit(1)).write.partitionBy("k").parquet(f"{tmp_path}/t")
    spark.sql(
        f"CREATE TABLE {database}.t (id BIGINT, k INT) USING parquet PARTITIONED BY (k) LOCATION '{tmp_path}/t'"
    )
    assert spark.table(f"{database}.t").count() == 0
    assert R.rows_out_of_sight(spark, f"{database}.t", "parquet")
    spark.sql(f"CREATE TABLE {database}.none (id BIGINT) USING parquet")
    assert not R.rows_out_of_sight(spark, f"{database}.none", "parquet")
    spark.range(0).write.saveAsTable(f"{database}.zero")
    assert not R.rows_out_of_sight(spark, f"{database}.zero", "parquet")
    assert table_exists(spark, f"{database}.zero")


def test_shuffles_of_a_rewrite(spark, database, monkeypatch):
    """A rebalance is asked for only where files must be brought together."""
    asked = []
    clustered = R.clustered
    monkeypatch.setattr(R, "clustered", lambda df, keys, *rest: asked.append(keys) or clustered(df, keys, *rest))
    spark.range(9).withColumn("k", F.lit(1)).write.partitionBy("k").saveAsTable(f"{database}.t")
    R.rewrite_table(spark, f"{database}.t", f"{database}.a", ["k"], small_files=False)
    assert asked == []
    R.rewrite_table(spark, f"{database}.t", f"{database}.b", ["id"], small_files=False)
    R.rewrite_table(spark, f"{database}.t", f"{database}.c", ["k"])
    assert asked == [["id"], ["k"]]


def test_partition_batches(spark, tmp_path):
    """Every row is in exactly one batch, whatever its partition value, and scans are pruned."""
    rows = spark.sql(
        "SELECT id, CASE WHEN id % 5 > 0 THEN concat('a=', id % 5, '/ \\'') END AS k, "
        "date_add(DATE '2024-01-01', CAST(id % 2 AS INT)) AS d FROM range(100)"
    )
    rows.write.partitionBy("k", "d").parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    parts = stored.select("k", "d").distinct().collect()
    batches = list(R.partition_batches(stored, ["k", "d"], parts, batch=3))
    assert len(batches) == 4
    assert sorted(r["id"] for b in batches for r in b.collect()) == list(range(100))
    plan = batches[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3 and "Exchange" not in plan and "DataFilters: []" in plan
