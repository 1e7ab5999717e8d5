"""Plan and result files: CSV with a header and a fixed column order, all values text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayout.operators.classify import PLAN_FIELDS, plan_fields
from relayout.session import sql_settings

# The columns of a run report.
RESULT_FIELDS = (
    "run_id", "table", "strategy", "mode", "status", "source_rows", "target_rows", "seconds",
    "state", "note",
)

_CSV = {"header": True, "multiLine": True, "escape": '"'}

# Shuffled bytes of one plan file. Values with line breaks keep a file from being read by several tasks.
PLAN_FILE_BYTES = 16 * 1024 * 1024


def write_plan(plan: DataFrame, path: str, file_bytes: int = PLAN_FILE_BYTES) -> None:
    """A CSV file in the folder ``path``, for people to edit: a row per table, in the plan's order.

    A plan too large for one task becomes several files of ``file_bytes``, each in the plan's order.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(file_bytes),
    }
    placed = plan_fields(plan).withColumn("__place", F.monotonically_increasing_id())
    dealt = placed.hint("rebalance").sortWithinPartitions("__place").drop("__place")
    with sql_settings(plan.sparkSession, settings):
        dealt.write.mode("errorifexists").options(**_CSV).csv(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, blank where empty; every plan column must be there."""
    plan = spark.read.options(**_CSV).csv(path)
    missing = [name for name in PLAN_FIELDS if name not in plan.columns]
    if not missing and plan.isEmpty():
        missing = list(PLAN_FIELDS)
    if missing:
        raise ValueError(f"the plan lacks columns: {missing}")
    return plan.na.fill("")


def write_results(results: DataFrame, path: str) -> None:
    columns = [F.col(name).cast("string").alias(name) for name in RESULT_FIELDS]
    results.select(*columns).write.mode("errorifexists").options(**_CSV).csv(path)
