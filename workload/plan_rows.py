"""Checks of plan rows, casts, layouts, the journal and run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayout.functions import layout as L
from relayout.functions import naming as N
from relayout.operators import gates as G
from relayout.operators.rewrite import cast_projection, with_layout
from relayout.sources.evidence import latest_state
from workload.fixtures import as_sql, load


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "plan").withColumnRenamed("table_name", "table")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "names").withColumnRenamed("table_name", "table")


def plan_select(spark: SparkSession, sf: str) -> DataFrame:
    return G.select_rows(_plan(spark, sf), _names(spark, sf)).select("table", "strategy", "approved")


def plan_select_missing(spark: SparkSession, sf: str) -> DataFrame:
    return G.missing_rows(_plan(spark, sf), _names(spark, sf))


def plan_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).select(
        "table",
        G.execute_refusal().alias("refusal"),
        G.execute_refusal(require_ticket=False).alias("refusal_without_ticket"),
        G.inplace_refusal().alias("inplace_refusal"),
    )


def plan_gate_compact(spark: SparkSession, sf: str) -> DataFrame:
    return G.to_compact(_plan(spark, sf)).select("table")


def plan_parse_casts(spark: SparkSession, sf: str) -> DataFrame:
    parsed = L.parse_casts(F.col("cast_columns"))
    casts = F.transform(parsed["casts"], lambda c: F.concat_ws(":", c["name"], c["dtype"]))
    return _plan(spark, sf).select(
        "table", F.array_join(casts, ";").alias("casts"), parsed["error"].alias("error")
    )


def plan_parse_partition_spec(spark: SparkSession, sf: str) -> DataFrame:
    parsed = L.parse_partition_spec(F.col("target_partition_spec"))
    return _plan(spark, sf).select(
        "table",
        F.array_join(parsed["expressions"], ";").alias("expressions"),
        parsed["error"].alias("error"),
    )


def plan_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("typed_name")
    return _plan(spark, sf).select(
        "table", N.is_table_name(name).alias("table_ok"), N.is_identifier(name).alias("identifier_ok")
    )


def plan_locations(spark: SparkSession, sf: str) -> DataFrame:
    refusal = G.location_refusal(F.col("target_location"), "hdfs://ns1/")
    return _plan(spark, sf).select("table", "target_location", refusal.alias("refusal"))


def plan_route(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).groupBy(G.route().alias("route")).agg(F.count(F.lit(1)).alias("n"))


def derived_names(spark: SparkSession, sf: str) -> DataFrame:
    names = N.derived_names(F.col("table"), F.lit("CHG-12-Mig"), F.lit("sandbox"))
    return _plan(spark, sf).select("table", *[value.alias(name) for name, value in names.items()])


def cast_projected(spark: SparkSession, sf: str) -> DataFrame:
    return cast_projection(load(spark, sf, "customer_small"), {"c_nationkey": "int"})


def cast_unknown(spark: SparkSession, sf: str) -> DataFrame:
    casts = L.parse_casts(F.col("cast_columns"))["casts"]
    unknown = L.unknown_casts(casts["name"], F.array(F.lit("id"), F.lit("b")))
    return _plan(spark, sf).select("table", F.array_join(unknown, ",").alias("unknown"))


def partition_transforms(spark: SparkSession, sf: str) -> DataFrame:
    spec = [f"{t}(o_orderdate)" for t in ("years", "months", "days", "hours")]
    orders, names, _ = with_layout(load(spark, sf, "orders"), spec)
    years, months, days, hours = names
    return orders.groupBy(F.col(years).alias("years"), F.col(months).alias("months")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(days).alias("first_day"),
        F.max(days).alias("last_day"),
        F.min(hours).alias("first_hour"),
        F.max(hours).alias("last_hour"),
    )


def partition_truncate(spark: SparkSession, sf: str) -> DataFrame:
    spec = ["truncate(4,p_name)", "TRUNCATE(100,p_partkey)", "bucket(16,p_partkey)"]
    part, names, _ = with_layout(load(spark, sf, "part"), spec)
    text, number, bucket = map(F.col, names)
    return part.groupBy(text.alias("prefix"), number.alias("hundred")).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and((bucket >= 0) & (bucket < 16)).alias("buckets_in_range"),
    )


def partition_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """A key always falls into the same bucket, and all buckets are in use."""
    lines, names, _ = with_layout(load(spark, sf, "lineitem"), ["bucket(16,l_partkey)"])
    pairs = lines.groupBy("l_partkey", F.col(names[0]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum("n").alias("n_rows"), F.countDistinct("bucket").alias("n_buckets"),
        F.min("bucket").alias("first"), F.max("bucket").alias("last"),
    )


def journal_latest(spark: SparkSession, sf: str) -> DataFrame:
    return latest_state(load(spark, sf, "journal").withColumnRenamed("table_name", "table"))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return G.run_summary(load(spark, sf, "results"))


QUERIES = {
    "plan_select": plan_select,
    "plan_select_missing": plan_select_missing,
    "plan_gate": plan_gate,
    "plan_gate_compact": plan_gate_compact,
    "plan_parse_casts": plan_parse_casts,
    "plan_parse_partition_spec": plan_parse_partition_spec,
    "plan_identifiers": plan_identifiers,
    "plan_locations": plan_locations,
    "plan_route": plan_route,
    "derived_names": derived_names,
    "cast_projection": cast_projected,
    "cast_unknown": cast_unknown,
    "partition_transforms": partition_transforms,
    "partition_truncate": partition_truncate,
    "partition_buckets": partition_buckets,
    "journal_latest": journal_latest,
    "run_summary": run_summary,
}

_GATE = f"""CASE WHEN approved <> 'Y' THEN '{G.NOT_APPROVED}'
                 WHEN target_format_version <> '2' THEN '{G.WRONG_VERSION}'
                 WHEN schema_compatible <> 'Y' THEN '{G.NOT_COMPATIBLE}' """

_ORACLE = {
    "plan_select": """
        SELECT table_name AS "table", strategy, approved FROM {plan}
        WHERE table_name IN (SELECT table_name FROM {names})""",
    "plan_select_missing": """
        SELECT DISTINCT table_name AS "table" FROM {names}
        WHERE table_name NOT IN (SELECT table_name FROM {plan}) ORDER BY 1""",
    "plan_gate": f"""
        SELECT table_name AS "table",
            {_GATE} WHEN trim(writer_freeze_ticket) = '' THEN '{G.NO_TICKET}' END AS refusal,
            {_GATE} END AS refusal_without_ticket,
            CASE WHEN strategy = 'migrate' AND source_type <> 'EXTERNAL' THEN '{G.NOT_EXTERNAL}' END
                AS inplace_refusal
        FROM {{plan}}""",
    "plan_gate_compact": """
        SELECT table_name AS "table" FROM {plan} WHERE approved = 'Y' AND compact = 'Y'""",
    "plan_parse_casts": """
        SELECT table_name AS "table",
            CASE cast_columns WHEN '' THEN '' WHEN 'a:int' THEN 'a:int'
                WHEN 'a:int;b:STRING' THEN 'a:int;b:string' END AS casts,
            CASE cast_columns WHEN 'a' THEN 'Invalid cast_columns item: ''a'''
                WHEN 'a:bigint' THEN 'no automatic cast to: ''bigint'''
                WHEN 'a b:int' THEN 'not a plain identifier: ''a b''' END AS error
        FROM {plan}""",
    "plan_parse_partition_spec": """
        SELECT table_name AS "table",
            CASE target_partition_spec WHEN 'days(ts); region' THEN 'days(ts);region'
                WHEN 'bucket(16, id)' THEN 'bucket(16,id)'
                WHEN '' THEN '' WHEN 'region' THEN 'region'
                WHEN 'TRUNCATE(4,name)' THEN 'TRUNCATE(4,name)' END AS expressions,
            CASE WHEN target_partition_spec IN ('bucket(0,id)', 'day(ts)', 'x) DROP')
                THEN 'no such partition transform: ''' || target_partition_spec || '''' END
                AS error
        FROM {plan}""",
    "plan_identifiers": r"""
        SELECT table_name AS "table",
            regexp_full_match(typed_name, '[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*') AS table_ok,
            regexp_full_match(typed_name, '[A-Za-z_][A-Za-z0-9_]*') AS identifier_ok
        FROM {plan}""",
    "plan_locations": f"""
        SELECT table_name AS "table", target_location,
            CASE target_location
                WHEN 'hdfs://other/data/t'
                THEN 'target_location authority ''other'' differs from fs.defaultFS ''ns1'''
                WHEN 'data/t' THEN '{G.NOT_ABSOLUTE}' END AS refusal
        FROM {{plan}}""",
    "plan_route": """
        SELECT CASE WHEN strategy IN ('skip', 'manual') THEN 'SKIPPED'
                    WHEN strategy = 'hive_ctas' THEN 'MANUAL_ACTION_REQUIRED' ELSE strategy END AS route,
            count(*) AS n
        FROM {plan} GROUP BY 1""",
    "derived_names": """
        SELECT table_name AS "table", table_name || '__ice' AS staging, table_name || '__legacy' AS legacy,
            table_name || '_BACKUP_' AS backup, table_name || '__failed_chg_12_mig' AS failed,
            'sandbox.db__t' || n || '__chg_12_mig' AS sandbox
        FROM {plan}""",
    "cast_projection": "SELECT * FROM {customer}",
    "cast_unknown": """
        SELECT table_name AS "table",
            CASE WHEN cast_columns = '' THEN '' WHEN cast_columns IN ('a:int', 'a:int;b:STRING') THEN 'a' END
                AS unknown
        FROM {plan}""",
    "partition_transforms": """
        SELECT CAST(year(o_orderdate) - 1970 AS INTEGER) AS years,
            CAST((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1 AS INTEGER) AS months,
            count(*) AS n,
            CAST(min(floor(epoch(o_orderdate) / 86400)) AS INTEGER) AS first_day,
            CAST(max(floor(epoch(o_orderdate) / 86400)) AS INTEGER) AS last_day,
            CAST(min(floor(epoch(o_orderdate) / 3600)) AS INTEGER) AS first_hour,
            CAST(max(floor(epoch(o_orderdate) / 3600)) AS INTEGER) AS last_hour
        FROM {orders} GROUP BY 1, 2""",
    "partition_truncate": """
        SELECT substr(p_name, 1, 4) AS prefix, p_partkey - p_partkey % 100 AS hundred, count(*) AS n,
            true AS buckets_in_range
        FROM {part} GROUP BY 1, 2""",
    "partition_buckets": """
        SELECT count(DISTINCT l_partkey) AS n_pairs, count(*) AS n_rows, CAST(16 AS BIGINT) AS n_buckets,
            0 AS first, 15 AS last
        FROM {lineitem}""",
    "journal_latest": """
        SELECT run_id, table_name AS "table", max(seq) AS seq, arg_max(state, seq) AS state
        FROM {journal} GROUP BY 1, 2 ORDER BY 1, 2""",
    "run_summary": """
        SELECT count(*) AS total,
            count(*) FILTER (status IN ('FAILED', 'VALIDATION_FAILED', 'AUTO_ROLLED_BACK')) AS failures,
            count(*) FILTER (status = 'MANUAL_ACTION_REQUIRED') AS manual, 1 AS exit_code
        FROM {results}""",
}
ORACLE = {name: as_sql(text) for name, text in _ORACLE.items()}
