"""Checks of classification, file sizes and assessment over an estate with one table per part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relayout.operators import assess as A
from relayout.operators import classify as K
from relayout.operators import compare as C
from relayout.plans.inventory import Assessment, assess_plan
from relayout.sources import files as S
from workload.fixtures import as_sql, load

#: What the estate's tables that need no migration look like.
TARGET = {"target_provider": "lake", "target_property": "table_type=LAKE"}


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The estate in the shape of a catalogue scan."""
    columns = F.array(
        F.struct(F.lit("id").alias("name"), F.lit("bigint").alias("dtype")),
        F.struct(F.lit("c").alias("name"), F.col("col_type").alias("dtype")),
        F.struct(F.lit("d").alias("name"), F.lit("VARCHAR(9)").alias("dtype")),
    )
    short = F.filter(columns, lambda c: (c["name"] != "d"))
    return load(spark, sf, "estate").select(
        "table_name", "type_raw", "provider", "serde", F.lit("").alias("input_format"),
        "table_properties", "num_buckets",
        F.when(F.col("n") % 29 == 0, columns).otherwise(short).alias("columns"),
        F.filter(F.array("partition_name"), lambda p: p != "").alias("partitions"),
        "location", "error",
    )


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return K.plan_rows(K.classify(_catalog(spark, sf), **TARGET))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    tables = _plan(spark, sf).selectExpr("table AS table_name", "location")
    return S.location_facts(tables, load(spark, sf, "files"))


def _assessment(spark: SparkSession, sf: str) -> Assessment:
    return assess_plan(_plan(spark, sf), _facts(spark, sf))


def _column_lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Column lists before and after a rewrite that went wrong for some tables."""
    estate = load(spark, sf, "estate")
    source = F.array(F.lit("id"), F.lit("c")), F.array(F.lit("bigint"), F.col("col_type"))
    renamed = F.when(F.col("n") % 23 == 0, "c2").when(F.col("n") % 5 == 0, "C").otherwise("c")
    widened = F.when(F.col("n") % 31 == 0, "date").otherwise(
        F.when(F.col("col_type") == "smallint", "INT")
        .when(F.col("col_type") == "char(3)", "string")
        .otherwise(F.col("col_type"))
    )
    wider = F.when(F.col("n") % 31 == 0, "string").otherwise("bigint")
    target = F.array(F.lit("id"), renamed), F.array(wider, widened)

    def listed(names: Column, types: Column, df: DataFrame) -> DataFrame:
        zipped = F.arrays_zip(names.alias("name"), types.alias("dtype"))
        return df.select("table_name", F.posexplode(zipped).alias("pos", "c")).select(
            "table_name", "pos", F.col("c.name").alias("name"), F.col("c.dtype").alias("dtype")
        )

    missing_last = listed(*target, estate).join(
        estate.where("n % 37 = 0").select("table_name", F.lit(1).alias("pos")),
        ["table_name", "pos"],
        "left_anti",
    )
    return listed(*source, estate), missing_last


def schema_diff(spark: SparkSession, sf: str) -> DataFrame:
    verdicts = C.schema_verdicts(C.schema_diff(*_column_lists(spark, sf)))
    return verdicts.select(
        "table_name", "schema_ok", F.array_join("details", "; ").alias("details")
    )


def schema_actions(spark: SparkSession, sf: str) -> DataFrame:
    actions = K.type_actions(_catalog(spark, sf))
    casts = F.transform("casts", lambda c: F.concat_ws(":", c["name"], c["dtype"]))
    return actions.select(
        "table_name",
        (F.size("blockers") == 0).alias("compatible"),
        F.array_join(casts, ";").alias("casts"),
        F.array_join("blockers", "; ").alias("blockers"),
    )


def classify_tables(spark: SparkSession, sf: str) -> DataFrame:
    return K.classify(_catalog(spark, sf), **TARGET).select(
        "table_name", "source_type", "format", "strategy", "note"
    )


def build_plan(spark: SparkSession, sf: str) -> DataFrame:
    return K.with_sizes(_plan(spark, sf), S.table_sizes(_facts(spark, sf)))


def file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    files = load(spark, sf, "files")
    tables = load(spark, sf, "documents").groupBy("source").agg(
        F.concat(F.lit("/wh/"), F.col("source"), F.lit("/")).alias("location")
    )
    sized = S.table_sizes(S.location_facts(tables.withColumnRenamed("source", "table_name"), files))
    return sized.select("table_name", "bytes", "files", "size_gb", "avg_file_mb", "compact")


def assess_locations(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf)


def assess_risk(spark: SparkSession, sf: str) -> DataFrame:
    return _assessment(spark, sf).tables.select(
        "table", "strategy", "risk_score", "risk_band", F.size("risk_reasons").alias("n_reasons")
    )


def assess_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return _assessment(spark, sf).tables.select("table", "risk_band", "risk_score", "finding")


def assess_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _assessment(spark, sf).summary


def strategy_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _assessment(spark, sf).strategies


QUERIES = {
    "schema_diff": schema_diff,
    "schema_actions": schema_actions,
    "classify_tables": classify_tables,
    "build_plan": build_plan,
    "file_inventory": file_inventory,
    "assess_locations": assess_locations,
    "assess_risk": assess_risk,
    "assess_ranked": assess_ranked,
    "assess_summary": assess_summary,
    "strategy_counts": strategy_counts,
}

_ACTIONS = """
    WITH actions AS (
        SELECT *,
            CASE WHEN col_type = 'smallint' THEN 'c:int' WHEN col_type LIKE 'char(%' THEN 'c:string' ELSE '' END
            || CASE WHEN n % 29 <> 0 THEN ''
                    WHEN col_type = 'smallint' OR col_type LIKE 'char(%' THEN ';d:string'
                    ELSE 'd:string' END AS casts,
            CASE WHEN col_type LIKE 'uniontype<%' OR col_type LIKE 'interval %' THEN 'c:' || col_type
                 WHEN col_type = 'struct<a:smallint>' THEN 'nested conversion required for c:' || col_type
                 ELSE '' END AS blockers
        FROM {estate}
    )"""

_CLASSIFIED = (
    _ACTIONS
    + f""",
    kinds AS (
        SELECT *, type_raw AS source_type,
            CASE WHEN lower(provider || serde) LIKE '%parquet%' THEN 'parquet'
                 WHEN lower(provider || serde) LIKE '%orc%' THEN 'orc'
                 WHEN lower(provider || serde) LIKE '%avro%' THEN 'avro' ELSE 'other' END AS format
        FROM actions
    ),
    ruled AS (
        SELECT *,
            CASE WHEN error IS NOT NULL THEN 0
                 WHEN source_type = 'VIEW' THEN 1
                 WHEN provider = 'lake' OR lower(table_properties) LIKE '%table_type=lake%' THEN 2
                 WHEN lower(table_properties) LIKE '%transactional=true%' THEN 3
                 WHEN blockers <> '' THEN 4
                 WHEN num_buckets = '8' THEN 5
                 WHEN source_type <> 'EXTERNAL' THEN 6
                 WHEN casts <> '' THEN 7
                 WHEN format = 'avro' THEN 8
                 WHEN format = 'other' THEN 9
                 WHEN lower(table_properties) LIKE '%translated_to_external=true%' THEN 10
                 ELSE 11 END AS rule
        FROM kinds
    ),
    classified AS (
        SELECT *,
            CASE WHEN rule IN (0, 4, 10) THEN 'manual' WHEN rule IN (1, 2) THEN 'skip'
                 WHEN rule = 3 THEN 'hive_ctas' WHEN rule = 11 THEN 'migrate' ELSE 'ctas' END AS strategy,
            CASE rule WHEN 0 THEN 'inventory error: ' || error WHEN 1 THEN '{K.NOTE_VIEW}'
                 WHEN 2 THEN '{K.NOTE_ALREADY}' WHEN 3 THEN '{K.NOTE_ACID}' WHEN 4 THEN blockers
                 WHEN 5 THEN '{K.NOTE_BUCKETS}' WHEN 6 THEN source_type || '{K.NOTE_KIND}'
                 WHEN 7 THEN '{K.NOTE_CASTS}' WHEN 8 THEN '{K.NOTE_AVRO}' WHEN 9 THEN '{K.NOTE_FORMAT}'
                 WHEN 10 THEN '{K.NOTE_TRANSLATED}' ELSE '{K.NOTE_ELIGIBLE}' END AS note
        FROM ruled
    )"""
)

_SIZES = """,
    listed AS (
        SELECT '/wh/' || source AS directory, CAST(sum(n_chars * 28000) AS BIGINT) AS bytes, count(*) AS files
        FROM {documents} GROUP BY source
    ),
    facts AS (
        SELECT e.table_name, e.location, l.bytes, l.files,
            CASE WHEN e.location = '' THEN 'Hive metastore did not return a table location'
                 WHEN l.files IS NULL THEN 'location not found: ' || e.location END AS error,
            round(l.bytes / greatest(l.files, 1) / 1048576, 2) AS average_file_mb,
            round(CAST(l.bytes AS DOUBLE) / CAST(1073741824 AS DOUBLE), 2) AS size_gb,
            round(CAST(l.bytes AS DOUBLE) / l.files / CAST(1048576 AS DOUBLE), 1) AS avg_file_mb
        FROM (SELECT table_name, CASE WHEN error IS NULL THEN location ELSE '' END AS location
              FROM {estate}) e LEFT JOIN listed l ON l.directory = e.location
    )"""

_SCORED = (
    _CLASSIFIED
    + _SIZES
    + f""",
    scored AS (
        SELECT c.table_name, c.strategy, c.note, f.bytes, f.avg_file_mb < 64 AS small,
            f.error IS NOT NULL AS failed,
            least(100, CASE c.strategy WHEN 'skip' THEN 0 WHEN 'migrate' THEN 25 WHEN 'ctas' THEN 55
                                       WHEN 'hive_ctas' THEN 75 ELSE 85 END
                       + CASE WHEN f.avg_file_mb < 64 THEN 10 ELSE 0 END
                       + CASE WHEN f.error IS NOT NULL THEN 10 ELSE 0 END) AS risk_score
        FROM classified c JOIN facts f USING (table_name)
    ),
    banded AS (
        SELECT *,
            CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 55 THEN 'high'
                 WHEN risk_score > 0 THEN 'moderate' ELSE 'not-applicable' END AS risk_band,
            note || CASE WHEN small THEN '; {A.REASON_SMALL_FILES}' ELSE '' END
                 || CASE WHEN failed THEN '; {A.REASON_NO_FACTS}' ELSE '' END AS finding,
            1 + CASE WHEN small THEN 1 ELSE 0 END + CASE WHEN failed THEN 1 ELSE 0 END AS n_reasons
        FROM scored
    )"""
)

_ORACLE = {
    "schema_diff": """
        SELECT table_name, NOT names_differ AND first = '' AND second = '' AS schema_ok,
            CASE WHEN names_differ THEN 'columns differ in name or order'
                 WHEN first <> '' AND second <> '' THEN first || '; ' || second
                 ELSE first || second END AS details
        FROM (
            SELECT table_name, n % 37 = 0 OR n % 23 = 0 AS names_differ,
                CASE WHEN n % 31 = 0 THEN 'type of id differs: bigint -> string' ELSE '' END AS first,
                CASE WHEN n % 31 = 0 THEN 'type of c differs: ' || col_type || ' -> date' ELSE '' END AS second
            FROM {estate}
        )""",
    "schema_actions": _ACTIONS
    + " SELECT table_name, blockers = '' AS compatible, casts, blockers FROM actions",
    "classify_tables": _CLASSIFIED
    + " SELECT table_name, source_type, format, strategy, note FROM classified",
    "build_plan": _CLASSIFIED
    + _SIZES
    + """, shaped AS (
        SELECT *, error IS NULL AS good, location <> '' AND strategy NOT IN ('skip', 'manual') AS sized
        FROM classified
    )
    SELECT s.table_name AS "table",
        CASE WHEN good THEN source_type ELSE '' END AS source_type, strategy, 'N' AS approved,
        '' AS writer_freeze_ticket, CASE WHEN good THEN format ELSE '' END AS format,
        CASE WHEN NOT good THEN '' WHEN blockers = '' THEN 'Y' ELSE 'N' END AS schema_compatible,
        CASE WHEN good THEN casts ELSE '' END AS cast_columns,
        CASE WHEN good THEN partition_name ELSE '' END AS partitions,
        CASE WHEN good THEN partition_name ELSE '' END AS target_partition_spec,
        CASE WHEN good THEN s.location ELSE '' END AS location, '' AS target_location,
        CASE WHEN sized THEN f.size_gb END AS size_gb, CASE WHEN sized THEN f.files END AS files,
        CASE WHEN sized THEN f.avg_file_mb END AS avg_file_mb,
        CASE WHEN sized AND f.avg_file_mb < 64 THEN 'Y' WHEN sized AND f.files IS NOT NULL THEN 'N'
             ELSE '' END AS compact,
        CASE WHEN good THEN '2' ELSE '' END AS target_format_version, note
    FROM shaped s JOIN facts f ON f.table_name = s.table_name""",
    "file_inventory": """
        SELECT source AS table_name, CAST(sum(n_chars * 28000) AS BIGINT) AS bytes, count(*) AS files,
            round(CAST(sum(n_chars * 28000) AS DOUBLE) / CAST(1073741824 AS DOUBLE), 2) AS size_gb,
            round(CAST(sum(n_chars * 28000) AS DOUBLE) / count(*) / CAST(1048576 AS DOUBLE), 1) AS avg_file_mb,
            CASE WHEN round(CAST(sum(n_chars * 28000) AS DOUBLE) / count(*) / CAST(1048576 AS DOUBLE), 1) < 64
                 THEN 'Y' ELSE 'N' END AS compact
        FROM {documents} GROUP BY source""",
    "assess_locations": "WITH none AS (SELECT 1)"
    + _SIZES
    + " SELECT table_name, location, bytes, files, error, average_file_mb FROM facts",
    "assess_risk": _SCORED
    + ''' SELECT table_name AS "table", strategy, risk_score, risk_band, n_reasons FROM banded''',
    "assess_ranked": _SCORED
    + """ SELECT table_name AS "table", risk_band, risk_score, finding FROM banded
          ORDER BY risk_score DESC, table_name""",
    "assess_summary": _SCORED
    + """, totals AS (
        SELECT count(*) AS objects_scanned, CAST(sum(bytes) AS BIGINT) AS total_bytes,
            CAST(sum(CASE WHEN strategy IN ('ctas', 'hive_ctas') THEN bytes END) AS BIGINT) AS rewrite_bytes
        FROM scored
    )
    SELECT *, round(CAST(total_bytes AS DOUBLE) / CAST(1073741824 AS DOUBLE), 2) AS total_gb,
        round(CAST(rewrite_bytes AS DOUBLE) / CAST(1073741824 AS DOUBLE), 2) AS rewrite_gb,
        round(CAST(rewrite_bytes AS DOUBLE) / CAST(1073741824 AS DOUBLE) / 250, 1) AS estimated_rewrite_hours,
        CAST(250 AS DOUBLE) AS assumed_gib_per_hour
    FROM totals""",
    "strategy_counts": _CLASSIFIED
    + " SELECT strategy, count(*) AS objects FROM classified GROUP BY strategy ORDER BY strategy",
}
ORACLE = {name: as_sql(text) for name, text in _ORACLE.items()}
