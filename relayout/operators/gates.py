"""Checks and routing of plan rows, before anything is changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Refusal texts, the only accepted target version, and result statuses.
NOT_APPROVED = "plan row is not approved=Y"
WRONG_VERSION = "target_format_version must be 2"
NOT_COMPATIBLE = "schema_compatible is not Y"
NO_TICKET = "writer_freeze_ticket is required for execute mode"
NOT_EXTERNAL = "migrate is only permitted for source_type=EXTERNAL"
NO_APPROVED_ROWS = "No approved rows selected"
NO_COMPACT_ROWS = "No approved compact=Y rows selected"
NOT_ABSOLUTE = (
    "target_location must be an absolute HDFS path or hdfs:// logical-nameservice URI"
)
FAILURE_STATUSES = ("FAILED", "VALIDATION_FAILED", "AUTO_ROLLED_BACK")
MANUAL_STATUS = "MANUAL_ACTION_REQUIRED"


def _value(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _yes(name: str) -> Column:
    return F.upper(_value(name)) == "Y"


def select_rows(plan: DataFrame, names: DataFrame) -> DataFrame:
    """Plan rows of the named tables; ``names`` has one column ``table``."""
    return plan.join(names, "table", "left_semi")


def missing_rows(plan: DataFrame, names: DataFrame) -> DataFrame:
    """Named tables the plan does not have, sorted."""
    return names.distinct().join(plan, "table", "left_anti").orderBy("table")


def approved(plan: DataFrame) -> DataFrame:
    return plan.where(_yes("approved"))


def to_compact(plan: DataFrame) -> DataFrame:
    return approved(plan).where(_yes("compact"))


def execute_refusal(require_ticket: bool = True) -> Column:
    """Why a row must not be executed, first reason only; NULL lets it pass."""
    refusal = (
        F.when(~_yes("approved"), NOT_APPROVED)
        .when(_value("target_format_version") != "2", WRONG_VERSION)
        .when(~_yes("schema_compatible"), NOT_COMPATIBLE)
    )
    if require_ticket:
        blank = F.regexp_replace(_value("writer_freeze_ticket"), r"\s+", "") == ""
        refusal = refusal.when(blank, NO_TICKET)
    return refusal


def inplace_refusal() -> Column:
    """Why a row must not be converted in place; NULL lets it pass and concerns no other strategy."""
    return F.when(
        (route() == "migrate") & (F.upper(_value("source_type")) != "EXTERNAL"), NOT_EXTERNAL
    )


def route() -> Column:
    """What a run does with a row: nothing, a manual action, one of two jobs, or an error."""
    strategy = F.lower(F.trim(_value("strategy")))
    return (
        F.when(strategy.isin("skip", "manual"), "SKIPPED")
        .when(strategy == "hive_ctas", MANUAL_STATUS)
        .when(strategy.isin("migrate", "ctas"), strategy)
        .otherwise(F.concat(F.lit("no such strategy: "), strategy))
    )


def location_refusal(location: Column, default_filesystem: str) -> Column:
    """Why a target location must not be used; blank locations are fine."""
    authority = F.regexp_extract(location, r"\Ahdfs://([^/]*)", 1)
    expected = default_filesystem.removeprefix("hdfs://").split("/", 1)[0]
    differs = F.concat(
        F.lit("target_location authority '"), authority,
        F.lit(f"' differs from fs.defaultFS '{expected}'"),
    )
    on_hdfs = location.startswith("hdfs://")
    return (
        F.when(location == "", F.lit(None).cast("string"))
        .when(on_hdfs & (authority != expected), differs)
        .when(~on_hdfs & ~location.startswith("/"), NOT_ABSOLUTE)
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Totals of a run; ``exit_code`` is 1 if anything failed or waits for a person."""
    counted = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status").isin(*FAILURE_STATUSES)).alias("failures"),
        F.count_if(F.col("status") == MANUAL_STATUS).alias("manual"),
    )
    attention = (F.col("failures") > 0) | (F.col("manual") > 0)
    return counted.withColumn("exit_code", attention.cast("int"))
