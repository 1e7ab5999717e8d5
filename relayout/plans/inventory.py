"""Inventory and assessment of whole databases. Nothing here changes a table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayout.operators import assess as A
from relayout.operators.classify import PLAN_FIELDS, classify, join_sizes, plan_fields, plan_rows, with_sizes
from relayout.sources.catalog import scan_catalog
from relayout.sources.files import measure_tables, table_sizes
from relayout.sources.plan_file import write_plan

# Fixed value: layout version of a written assessment.
ASSESSMENT_VERSION = 1


def plan_with_sizes(catalog: DataFrame, facts: DataFrame, **rules: object) -> DataFrame:
    """Plan rows with the sizes of the tables that have work to do.

    A table whose directory could not be measured is left to manual review, like one that could
    not be described.
    """
    failed = facts.where("error IS NOT NULL AND location <> ''").selectExpr(
        "table_name", "error AS size_error"
    )
    merged = catalog.join(failed, "table_name", "left").selectExpr(
        "* EXCEPT (error, size_error)", "coalesce(error, size_error) AS error"
    )
    return with_sizes(plan_rows(classify(merged, **rules)), table_sizes(facts))


def inventory(
    spark: SparkSession,
    databases: Iterable[str] | str,
    with_size: bool = False,
    **rules: object,
) -> DataFrame:
    """One editable, unapproved plan row per table; ``rules`` are the options of ``classify``."""
    catalog = scan_catalog(spark, databases)
    classified = classify(catalog, **rules)
    if not with_size:
        return plan_rows(classified)
    work = classified.where("strategy NOT IN ('skip', 'manual')")
    facts = measure_tables(spark, work.select("table_name", "location", "partitions"))
    return plan_with_sizes(catalog, facts, **rules)


@dataclass(frozen=True)
class Assessment:
    """``tables`` ranked by risk, estate totals, objects per strategy, and an editable plan."""

    tables: DataFrame
    summary: DataFrame
    strategies: DataFrame
    plan: DataFrame
    gib_per_hour: float = A.REWRITE_GIB_PER_HOUR

    def limits(self) -> list[str]:
        """What the report does not know."""
        return [
            "read from the catalogue and the file system; no table was read or changed",
            f"hours assume {self.gib_per_hour:g} GiB rewritten an hour, which was not measured here",
            "sizes are those of the files at the time of the listing",
            "writers, readers, grants and the text of views were not looked at",
        ]

    def write(self, folder: str, databases: str = "") -> None:
        """The report as JSON below ``folder``, with its scope and limits, and the plan as CSV."""
        stamped = self.summary.selectExpr(
            f"{ASSESSMENT_VERSION} AS assessment_version", "current_timestamp() AS generated_at", "*"
        ).withColumns(
            {
                "databases": F.lit(databases),
                "scope": F.lit("read-only assessment of whole databases"),
                "limits": F.array(*map(F.lit, self.limits())),
            }
        )
        stamped.write.mode("errorifexists").json(f"{folder}/summary")
        self.tables.write.mode("errorifexists").json(f"{folder}/tables")
        self.strategies.write.mode("errorifexists").json(f"{folder}/strategies")
        write_plan(self.plan, f"{folder}/plan")


def assess_plan(
    plan: DataFrame, facts: DataFrame, gib_per_hour: float = A.REWRITE_GIB_PER_HOUR
) -> Assessment:
    """Rank plan rows by risk. Every table with a location is sized, whatever its strategy."""
    sizes = table_sizes(facts).selectExpr(
        "table_name", "size_gb", "files", "avg_file_mb", "compact",
        "struct(location, bytes, files, average_file_mb, error) AS facts",
    )
    sized = join_sizes(plan, sizes, every_table=True)
    scored = A.risk(sized)
    return Assessment(
        tables=A.ranked(scored).select(
            *PLAN_FIELDS, "facts", "risk_band", "risk_score", "risk_reasons", "finding"
        ),
        summary=A.summary(scored, gib_per_hour),
        strategies=A.strategy_counts(plan),
        plan=plan_fields(sized),
        gib_per_hour=gib_per_hour,
    )


def assess(
    spark: SparkSession,
    databases: Iterable[str] | str,
    gib_per_hour: float = A.REWRITE_GIB_PER_HOUR,
    **rules: object,
) -> Assessment:
    """Readiness assessment of whole databases; ``rules`` are the options of ``classify``."""
    catalog = scan_catalog(spark, databases)
    facts = measure_tables(spark, catalog.select("table_name", "location", "partitions"))
    return assess_plan(plan_rows(classify(catalog, **rules)), facts, gib_per_hour)
