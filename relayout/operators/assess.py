"""Readiness assessment: risk per table, ranking and estate totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Risk points per strategy, additions, bands and reasons.
BASE_RISK = {"skip": 0, "migrate": 25, "ctas": 55, "hive_ctas": 75, "manual": 85}
UNKNOWN_RISK = 85
ADDED_RISK = 10
BANDS = ((80, "critical"), (55, "high"), (1, "moderate"))
NO_BAND = "not-applicable"
REASON_SMALL_FILES = "small-file remediation should be planned"
REASON_NO_FACTS = "HDFS metadata collection failed"
REWRITE_STRATEGIES = ("ctas", "hive_ctas")
REWRITE_GIB_PER_HOUR = 250.0

def risk(rows: DataFrame) -> DataFrame:
    """Add ``risk_score``, ``risk_band`` and ``risk_reasons`` to plan rows with location ``facts``.

    A view has no location, so it scores that addition too.
    """
    bases = " ".join(f"WHEN '{strategy}' THEN {points}" for strategy, points in BASE_RISK.items())
    bands = " ".join(f"WHEN risk_score >= {floor} THEN '{band}'" for floor, band in BANDS)
    small, failed = "compact = 'Y'", "coalesce(facts.error, '') <> ''"
    score = (
        f"least(100, CASE strategy {bases} ELSE {UNKNOWN_RISK} END"
        f" + if({small}, {ADDED_RISK}, 0) + if({failed}, {ADDED_RISK}, 0))"
    )
    reasons = f"array(note, if({small}, '{REASON_SMALL_FILES}', ''), if({failed}, '{REASON_NO_FACTS}', ''))"
    return rows.selectExpr("*", f"{score} AS risk_score").selectExpr(
        "*",
        f"CASE {bands} ELSE '{NO_BAND}' END AS risk_band",
        f"filter({reasons}, reason -> reason <> '') AS risk_reasons",
    )


def ranked(assessed: DataFrame) -> DataFrame:
    """Highest risk first, then by table, with the reasons as one text."""
    return assessed.withColumn("finding", F.array_join("risk_reasons", "; ")).orderBy(
        F.desc("risk_score"), F.asc("table")
    )


def strategy_counts(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy("strategy").agg(F.count(F.lit(1)).alias("objects")).orderBy("strategy")


def summary(assessed: DataFrame, gib_per_hour: float = REWRITE_GIB_PER_HOUR) -> DataFrame:
    """One row of estate totals; tables that share a directory each count its bytes."""
    rewritten = ", ".join(map(repr, REWRITE_STRATEGIES))
    totals = assessed.agg(
        F.expr("count(1) AS objects_scanned"),
        F.expr("coalesce(sum(facts.bytes), 0L) AS total_bytes"),
        F.expr(f"coalesce(sum(facts.bytes) FILTER (WHERE strategy IN ({rewritten})), 0L) AS rewrite_bytes"),
    )
    gib = "CAST({} AS DOUBLE) / 1073741824D"
    hours = f"round({gib.format('rewrite_bytes')} / {float(gib_per_hour)}D, 1)"
    return totals.selectExpr(
        "*",
        f"round({gib.format('total_bytes')}, 2) AS total_gb",
        f"round({gib.format('rewrite_bytes')}, 2) AS rewrite_gb",
        f"{hours if gib_per_hour > 0 else 'CAST(NULL AS DOUBLE)'} AS estimated_rewrite_hours",
        f"{float(gib_per_hour)}D AS assumed_gib_per_hour",
    )
