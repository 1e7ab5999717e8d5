"""Classification, types, plan parsing, gates and risk."""

import pytest
from pyspark.sql import functions as F

from relayout.functions import datatypes as D
from relayout.functions import layout as L
from relayout.functions import naming as N
from relayout.operators import assess as A
from relayout.operators import classify as K
from relayout.operators import gates as G
from relayout.sources.catalog import CATALOG_SCHEMA

EXTERNAL_PARQUET = {
    "table_name": "db.t", "type_raw": "EXTERNAL", "provider": "parquet", "table_properties": "[]",
    "columns": [("a", "int")], "partitions": ["p", "q"], "location": "/x",
}


def classified(spark, allow_avro=False, **changes):
    catalog = spark.createDataFrame([{**EXTERNAL_PARQUET, **changes}], CATALOG_SCHEMA)
    return K.classify(catalog, allow_avro, "lake", "table_type=lake")


@pytest.mark.parametrize(
    "changes, strategy, note",
    [
        ({}, "migrate", K.NOTE_ELIGIBLE),
        ({"type_raw": "VIRTUAL_VIEW"}, "skip", K.NOTE_VIEW),
        ({"type_raw": "VIEW", "provider": "lake"}, "skip", K.NOTE_VIEW),
        ({"provider": "Lake"}, "skip", K.NOTE_ALREADY),
        ({"table_properties": "[x=y, table_type=LAKE]"}, "skip", K.NOTE_ALREADY),
        ({"table_properties": "[transactional=TRUE]"}, "hive_ctas", K.NOTE_ACID),
        ({"columns": [("a", "uniontype<int,string>")]}, "manual", "a:uniontype<int,string>"),
        (
            {"columns": [("a", "interval year"), ("b", "array<smallint>")]},
            "manual",
            "a:interval year; nested conversion required for b:array<smallint>",
        ),
        ({"num_buckets": "8"}, "ctas", K.NOTE_BUCKETS),
        ({"num_buckets": "0"}, "migrate", K.NOTE_ELIGIBLE),
        ({"num_buckets": "-1"}, "migrate", K.NOTE_ELIGIBLE),
        ({"num_buckets": "8", "type_raw": "MANAGED"}, "ctas", K.NOTE_BUCKETS),
        ({"type_raw": "MANAGED_TABLE"}, "ctas", "MANAGED table is not eligible for in-place migrate"),
        ({"type_raw": None}, "ctas", "UNKNOWN table is not eligible for in-place migrate"),
        ({"columns": [("a", "char(3)")]}, "ctas", K.NOTE_CASTS),
        ({"provider": "hive", "serde": "AvroSerDe"}, "ctas", K.NOTE_AVRO),
        ({"provider": "hive", "serde": "LazySimpleSerDe"}, "ctas", K.NOTE_FORMAT),
        ({"provider": "hive", "input_format": "OrcInputFormat"}, "migrate", K.NOTE_ELIGIBLE),
        ({"table_properties": "[TRANSLATED_TO_EXTERNAL=TRUE]"}, "manual", K.NOTE_TRANSLATED),
        ({"error": "denied", "type_raw": "VIEW"}, "manual", "inventory error: denied"),
    ],
)
def test_strategy(spark, changes, strategy, note):
    row = classified(spark, **changes).first()
    assert (row["strategy"], row["note"]) == (strategy, note)


def test_avro_may_be_allowed(spark):
    row = classified(spark, True, provider="hive", serde="AvroSerDe").first()
    assert (row["format"], row["strategy"]) == ("avro", "migrate")


def test_first_format_wins(spark):
    assert classified(spark, provider="orc", serde="ParquetSerDe").first()["format"] == "parquet"


def test_plan_row(spark):
    columns = [("a", "smallint"), ("b", "VARCHAR(9)"), ("c", "int")]
    row = K.plan_rows(classified(spark, columns=columns)).first().asDict()
    assert list(row) == list(K.PLAN_FIELDS)
    assert row["cast_columns"] == "a:int;b:string"
    assert (row["approved"], row["schema_compatible"], row["partitions"]) == ("N", "Y", "p;q")
    assert (row["target_partition_spec"], row["target_format_version"]) == ("p;q", "2")
    assert (row["size_gb"], row["files"], row["compact"]) == (None, None, "")


def test_plan_row_of_a_failed_inspection(spark):
    row = K.plan_rows(classified(spark, error="denied")).first().asDict()
    filled = {name: value for name, value in row.items() if value}
    assert filled == {
        "table": "db.t", "strategy": "manual", "approved": "N", "note": "inventory error: denied",
    }


@pytest.mark.parametrize(
    "dtype, normal, cast, blocked",
    [
        ("TINYINT", "int", "int", False),
        ("smallint ", "smallint ", "int", False),
        ("Char(3)", "string", "string", False),
        ("varchar(3)", "string", "string", False),
        ("struct<smallint_x:int>", "struct<smallint_x:int>", None, True),
        ("interval day", "interval day", None, True),
        ("bigint", "bigint", None, False),
    ],
)
def test_types(spark, dtype, normal, cast, blocked):
    row = spark.createDataFrame([("c", dtype)], "n string, t string").selectExpr(
        D.normalized_type("t"), D.cast_target("t"), f"{D.type_blocker('n', 't')} IS NOT NULL"
    )
    assert tuple(row.first()) == (normal, cast, blocked)


def on(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression).first()[0]


@pytest.mark.parametrize(
    "text, casts, error",
    [
        ("", [], None),
        (";;a:int;", [("a", "int")], None),
        ("a:int;b:STRING", [("a", "int"), ("b", "string")], None),
        ("a:int;a:string", [("a", "string")], None),
        ("a", None, "Invalid cast_columns item: 'a'"),
        ("a:int;b:bigint;c", None, "no automatic cast to: 'bigint'"),
        ("a:int:x", None, "no automatic cast to: 'int:x'"),
        ("a b:int", None, "not a plain identifier: 'a b'"),
        (" :int", None, "not a plain identifier: ' '"),
    ],
)
def test_parse_casts(spark, text, casts, error):
    found = on(spark, text, L.parse_casts(F.col("v")))
    pairs = None if found["casts"] is None else [tuple(p) for p in found["casts"]]
    assert (pairs, found["error"]) == (casts, error)


@pytest.mark.parametrize(
    "text, expressions",
    [
        ("", []),
        (" ; ", []),
        ("region", ["region"]),
        ("days(ts); region", ["days(ts)", "region"]),
        ("Bucket( 16 , id )", ["Bucket(16,id)"]),
        ("truncate(4,name)", ["truncate(4,name)"]),
        ("bucket(0,id)", None),
        ("bucket(id)", None),
        ("day(ts)", None),
        ("x) DROP TABLE t", None),
        ("a\nb", None),
    ],
)
def test_parse_partition_spec(spark, text, expressions):
    found = on(spark, text, L.parse_partition_spec(F.col("v")))
    assert found["expressions"] == expressions
    assert (found["error"] is None) == (expressions is not None)


@pytest.mark.parametrize(
    "name, ok", [("db.t", True), ("_d._1", True), ("db", False), ("db.t\n", False), ("d.t.x", False), ("", False)]
)
def test_table_names(spark, name, ok):
    assert on(spark, name, N.is_table_name(F.col("v"))) is ok
    if ok:
        assert N.quoted_table(name) == "`{}`.`{}`".format(*name.split("."))
    else:
        with pytest.raises(ValueError):
            N.quoted_table(name)


@pytest.mark.parametrize(
    "location, ok",
    [
        ("", True), ("/data", True), ("hdfs://ns1/data", True), ("hdfs://ns1", True),
        ("hdfs://ns2/data", False), ("hdfs://", False), ("data", False), ("s3a://b/data", False),
    ],
)
def test_locations(spark, location, ok):
    assert (on(spark, location, G.location_refusal(F.col("v"), "hdfs://ns1/x")) is None) is ok


def plan_row(spark, **changes):
    row = {
        "table": "db.t", "strategy": "migrate", "source_type": "external", "approved": "y",
        "writer_freeze_ticket": "CHG1", "schema_compatible": "Y", "target_format_version": "2",
        "compact": "N",
    } | changes
    return spark.createDataFrame([row], ", ".join(f"{name} string" for name in row))


@pytest.mark.parametrize(
    "changes, refusal",
    [
        ({}, None),
        ({"approved": "N", "target_format_version": "1"}, G.NOT_APPROVED),
        ({"approved": None}, G.NOT_APPROVED),
        ({"target_format_version": "1", "schema_compatible": "N"}, G.WRONG_VERSION),
        ({"schema_compatible": "N", "writer_freeze_ticket": ""}, G.NOT_COMPATIBLE),
        ({"writer_freeze_ticket": " \t"}, G.NO_TICKET),
    ],
)
def test_gate(spark, changes, refusal):
    assert plan_row(spark, **changes).select(G.execute_refusal()).first()[0] == refusal


def test_gate_of_in_place_conversion(spark):
    assert plan_row(spark).select(G.inplace_refusal()).first()[0] is None
    managed = plan_row(spark, source_type="MANAGED")
    assert managed.select(G.inplace_refusal()).first()[0] == G.NOT_EXTERNAL
    assert managed.withColumn("strategy", F.lit("ctas")).select(G.inplace_refusal()).first()[0] is None


@pytest.mark.parametrize(
    "strategy, route",
    [
        ("skip", "SKIPPED"), (" Manual ", "SKIPPED"), ("hive_ctas", G.MANUAL_STATUS),
        ("CTAS", "ctas"), ("migrate", "migrate"), ("drop", "no such strategy: drop"),
    ],
)
def test_route(spark, strategy, route):
    assert plan_row(spark, strategy=strategy).select(G.route()).first()[0] == route


@pytest.mark.parametrize(
    "strategy, compact, error, score, band, reasons",
    [
        ("skip", "N", None, 0, "not-applicable", ["n"]),
        ("skip", "", "gone", 10, "moderate", ["n", A.REASON_NO_FACTS]),
        ("migrate", "Y", None, 35, "moderate", ["n", A.REASON_SMALL_FILES]),
        ("ctas", "N", None, 55, "high", ["n"]),
        ("hive_ctas", "Y", None, 85, "critical", ["n", A.REASON_SMALL_FILES]),
        ("manual", "Y", "gone", 100, "critical", ["n", A.REASON_SMALL_FILES, A.REASON_NO_FACTS]),
        ("other", None, "", 85, "critical", ["n"]),
    ],
)
def test_risk(spark, strategy, compact, error, score, band, reasons):
    rows = spark.createDataFrame(
        [(strategy, "n", compact, (error,))],
        "strategy string, note string, compact string, facts struct<error:string>",
    )
    row = A.risk(rows).first()
    assert (row["risk_score"], row["risk_band"], row["risk_reasons"]) == (score, band, reasons)


def test_summary_without_throughput(spark):
    rows = spark.createDataFrame([("ctas", (1 << 40,))], "strategy string, facts struct<bytes:bigint>")
    row = A.summary(rows, 100).first()
    assert (row["total_gb"], row["rewrite_gb"], row["estimated_rewrite_hours"]) == (1024.0, 1024.0, 10.2)
    assert A.summary(rows, 0).first()["estimated_rewrite_hours"] is None
    assert A.summary(rows.limit(0)).first()["total_bytes"] == 0


def test_run_summary(spark):
    def summary(*statuses):
        return tuple(G.run_summary(spark.createDataFrame([(s,) for s in statuses], "status string")).first())

    assert summary("SKIPPED", "CUTOVER_VALIDATED") == (2, 0, 0, 0)
    assert summary("FAILED", "AUTO_ROLLED_BACK", "VALIDATION_FAILED") == (3, 3, 0, 1)
    assert summary(G.MANUAL_STATUS) == (1, 0, 1, 1)
