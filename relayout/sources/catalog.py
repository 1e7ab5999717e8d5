"""Catalogue rows: one per table, with declared types, partitions, location and properties."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from relayout.functions.naming import quoted, quoted_table

CATALOG_SCHEMA = (
    "table_name string, type_raw string, provider string, serde string, input_format string, "
    "table_properties string, num_buckets string, "
    "columns array<struct<name:string,dtype:string>>, partitions array<string>, "
    "location string, error string"
)

# Fixed value: how a partition without a value is shown.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def list_tables(spark: SparkSession, databases: Iterable[str] | str) -> DataFrame:
    """Tables and views of the databases as ``table_name``; temporary views are left out."""
    if isinstance(databases, str):
        databases = databases.split(",")
    listed = spark.createDataFrame([], "table_name string")
    for database in filter(None, map(str.strip, databases)):
        tables = spark.sql(f"SHOW TABLES IN {quoted(database)}").where(~F.col("isTemporary"))
        names = F.concat_ws(".", F.lit(database), F.col("tableName"))
        listed = listed.unionByName(tables.select(names.alias("table_name")))
    return listed


def describe_table(spark: SparkSession, table: str) -> dict:
    """One catalogue row. Column types come as declared, which the table's schema does not keep."""
    name = quoted_table(table)
    described = json.loads(spark.sql(f"DESCRIBE EXTENDED {name} AS JSON").first()[0])
    columns = []
    for row in spark.sql(f"DESCRIBE {name}").collect():
        if not row["col_name"] or row["col_name"].startswith("#"):
            break
        columns.append((row["col_name"], row["data_type"]))
    properties = ", ".join(f"{k}={v}" for k, v in described.get("table_properties", {}).items())
    return {
        "table_name": table,
        "type_raw": described.get("type", ""),
        "provider": described.get("provider", ""),
        "serde": described.get("serde_library", ""),
        "input_format": described.get("input_format", described.get("inputformat", "")),
        "table_properties": f"[{properties}]",
        "num_buckets": str(described.get("num_buckets", "")),
        "columns": columns,
        "partitions": described.get("partition_columns", []),
        "location": described.get("location", ""),
        "error": None,
    }


def scan_catalog(spark: SparkSession, databases: Iterable[str] | str, calls: int = 8) -> DataFrame:
    """Describe every table of the databases; a table that cannot be described carries its error.

    Any failure counts, also those of the metastore and file systems below Spark. The work is metastore calls, ``calls`` of them at a time.
    """

    def described(table: str) -> dict:
        try:
            return describe_table(spark, table)
        except Exception as failure:
            return {"table_name": table, "columns": [], "partitions": [], "error": str(failure)}

    names = [row["table_name"] for row in list_tables(spark, databases).collect()]
    with ThreadPoolExecutor(calls) as pool:
        return spark.createDataFrame(list(pool.map(described, names)), CATALOG_SCHEMA)


def table_exists(spark: SparkSession, table: str) -> bool:
    quoted_table(table)
    return spark.catalog.tableExists(table)


def partition_places(spark: SparkSession, table: str, calls: int = 8) -> list[tuple[str, str]]:
    """Each registered partition as SHOW PARTITIONS prints it, and where it is stored; metastore calls only."""

    def located(row: Row) -> tuple[str, str]:
        return row[0], partition_location(spark, table, partition_spec(row[0]))

    with ThreadPoolExecutor(calls) as pool:
        return list(pool.map(located, spark.sql(f"SHOW PARTITIONS {quoted_table(table)}").collect()))


def partition_locations(spark: SparkSession, table: str, calls: int = 8) -> dict[str, str]:
    """Where each registered partition of a table is stored, by its SQL spec."""
    return {partition_spec(shown): place for shown, place in partition_places(spark, table, calls)}


def partition_location(spark: SparkSession, table: str, spec: str) -> str:
    described = spark.sql(f"DESCRIBE EXTENDED {quoted_table(table)} PARTITION ({spec})").collect()
    inside = itertools.dropwhile(lambda r: r["col_name"] != "# Detailed Partition Information", described)
    return next(r["data_type"] for r in inside if r["col_name"] == "Location")


def partition_spec(shown: str) -> str:
    """The SQL spec of a partition as SHOW PARTITIONS prints it: ``a=1/b=x``."""
    parts = []
    for part in shown.split("/"):
        name, value = part.split("=", 1)
        text = unquote(value).replace("\\", "\\\\").replace("'", "\\'")
        parts.append(f"`{unquote(name)}`=" + ("NULL" if value == NO_VALUE else f"'{text}'"))
    return ", ".join(parts)


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
