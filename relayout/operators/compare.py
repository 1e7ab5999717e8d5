"""Content comparison of two tables: one scan per side, everything else from the fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relayout.functions.canonical import column, quote
from relayout.functions.datatypes import normalized_field, normalized_type
from relayout.functions.fingerprint import MEASURES, fingerprint

# Mismatching key values that the text of a verdict spells out; it says how many there are.
SHOWN_EXAMPLES = 20

# Beyond some 80 columns the generated hash method is too large for the JVM to compile, and rows
# are interpreted. With this limit such stages are generated in small methods instead.
WIDE_TABLES = {"spark.sql.codegen.hugeMethodLimit": "8000"}

_SIDES = ("source", "target")


# -- schemas ---------------------------------------------------------------------------------


def schema_details(source: T.StructType, target: T.StructType) -> list[str]:
    """Differences between two DataFrame schemas; empty where they are compatible."""
    if [f.name.lower() for f in source] != [f.name.lower() for f in target]:
        return ["columns differ in name or order"]
    return [
        f"type of {s.name} differs: {s.dataType.simpleString()} -> {t.dataType.simpleString()}"
        for s, t in zip(source, target)
        if normalized_field(s.dataType) != normalized_field(t.dataType)
    ]


def retyped_positions(source: T.StructType, target: T.StructType) -> frozenset[int]:
    """Positions whose types differ, so that only their text is comparable."""
    return frozenset(
        position
        for position, (s, t) in enumerate(zip(source, target))
        if normalized_field(s.dataType) != normalized_field(t.dataType)
    )


def schema_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Compare the column lists of many tables at once.

    Both sides are ``(table_name, pos, name, dtype)``. Names are compared without case and by
    position; types are judged only for tables whose names agree. One row per position.
    """
    left = source.selectExpr(
        "table_name", "pos", "name AS source_name", "dtype AS source_type"
    )
    right = target.selectExpr(
        "table_name", "pos", "name AS target_name", "dtype AS target_type"
    )
    return left.join(right, ["table_name", "pos"], "full_outer").selectExpr(
        "*",
        "lower(source_name) <=> lower(target_name) AS name_ok",
        f"{normalized_type('source_type')} <=> {normalized_type('target_type')} AS type_ok",
    )


def schema_verdicts(diff: DataFrame) -> DataFrame:
    """One verdict per table from ``schema_diff``; a name difference hides type differences.

    What is gathered per table is bounded by its number of columns.
    """
    mismatch = "concat('type of ', source_name, ' differs: ', source_type, ' -> ', target_type)"
    found = diff.groupBy("table_name").agg(
        F.expr("bool_and(name_ok) AS names_ok"),
        F.expr(f"array_agg(CASE WHEN NOT type_ok THEN struct(pos, {mismatch} AS text) END) AS found"),
    )
    details = """CASE WHEN names_ok THEN transform(array_sort(found), f -> f.text)
                 ELSE array('columns differ in name or order') END"""
    return found.selectExpr("table_name", f"{details} AS details").selectExpr(
        "table_name", "size(details) = 0 AS schema_ok", "details"
    )


# -- contents --------------------------------------------------------------------------------


def compare_fingerprints(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pair the fingerprints of both sides, one row per key value, NULL keys included.

    A side without the key has NULL measures. The union form needs no join, so NULL keys pair up
    and no key value is ever matched against another.
    """
    key_types = [
        (key, source.schema[source.columns.index(key)], target.schema[target.columns.index(key)])
        for key in keys
    ]
    retyped = {
        key
        for key, s, t in key_types
        if normalized_field(s.dataType) != normalized_field(t.dataType)
    }
    keyed = [
        f"CAST({quote(key)} AS STRING) AS {quote(key)}" if key in retyped else quote(key)
        for key in keys
    ]

    def placed(side: str) -> list[str]:
        return keyed + [
            f"{name if s == side else 'NULL'} AS {s}_{name}" for s in _SIDES for name in MEASURES
        ]

    both = source.selectExpr(*placed("source")).union(target.selectExpr(*placed("target")))
    measured = [F.expr(f"max({s}_{name}) AS {s}_{name}") for s in _SIDES for name in MEASURES]
    same = " AND ".join(
        ["source_row_count IS NOT NULL", "target_row_count IS NOT NULL"]
        + [f"source_{name} <=> target_{name}" for name in MEASURES]
    )
    paired = both.groupBy(*map(quote, keys)).agg(*measured)
    return paired.withColumn("matches", F.expr(same))


def compare_contents(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str] = (),
    fingerprints: Callable[[DataFrame, Sequence[str], Collection[int]], DataFrame] = fingerprint,
) -> DataFrame:
    """Fingerprint each side once and pair the results per key value."""
    as_text = retyped_positions(source.schema, target.schema)
    return compare_fingerprints(
        fingerprints(source, keys, as_text), fingerprints(target, keys, as_text), keys
    )


def mismatches(compared: DataFrame) -> DataFrame:
    return compared.where(~F.col("matches"))


def mismatch_examples(
    compared: DataFrame, keys: Sequence[str], limit: int | None = None
) -> DataFrame:
    """The mismatching key values in key order; the first ``limit`` of them if the caller gives one."""
    ordered = mismatches(compared).orderBy(*map(column, keys))
    return ordered if limit is None else ordered.limit(limit)


def content_totals(compared: DataFrame) -> DataFrame:
    """Totals of both sides and the number of groups and mismatches, from the paired fingerprints."""
    totals = []
    for side in _SIDES:
        rows = f"{side}_row_count"
        totals += [f"coalesce(sum({rows}), 0L) AS {side}_rows", f"count({rows}) AS {side}_groups"]
        totals += [
            f"CAST(sum({side}_{name}) AS DECIMAL(38,0)) AS {side}_{name}" for name in MEASURES[1:]
        ]
    return compared.agg(*map(F.expr, totals), F.expr("count_if(NOT matches) AS mismatching_groups"))


# Equality over the columns of ``content_totals``; two empty tables are equal.
TOTALS_MATCH = " AND ".join(
    ["source_rows = target_rows"] + [f"source_{name} <=> target_{name}" for name in MEASURES[1:]]
)


# -- verdict ---------------------------------------------------------------------------------


def validate(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str] = (),
    max_partitions: int | None = None,
    fingerprints: Callable[[DataFrame, Sequence[str], Collection[int]], DataFrame] = fingerprint,
) -> DataFrame:
    """One row: is the target a faithful copy of the source?

    ``fingerprints`` makes the fingerprints of a side, from a scan of it if nothing else is given.

    Any number of groups is compared; ``max_partitions`` is a limit only the caller may want.
    ``ok`` needs compatible schemas, equal contents and no mismatching group. ``partition_ok`` is
    NULL where no keys were asked for. ``details`` tells what failed: schema, groups, totals.
    """
    schema_found = schema_details(source.schema, target.schema)
    missing = [k for k in keys if k not in source.columns or k not in target.columns]
    grouped = bool(keys) and not missing
    compared = compare_contents(source, target, keys if grouped else (), fingerprints)
    totals = content_totals(compared)
    if grouped:
        # A scalar subquery over the same fingerprints; at most SHOWN_EXAMPLES rows.
        shown = ", ".join(map(quote, compared.columns))
        examples = mismatch_examples(compared, keys, SHOWN_EXAMPLES).agg(
            F.expr(f"to_json(collect_list(struct({shown})))")
        )
        totals = totals.withColumn("examples", examples.scalar())
        refused = "false"
        if max_partitions is not None:
            refused = f"greatest(source_groups, target_groups) > {max_partitions}"
        partition_ok = f"NOT ({refused}) AND mismatching_groups = 0"
        partition_detail = f"""CASE
            WHEN {refused} THEN concat('groups not judged: ', source_groups, ' in source and ',
                target_groups, ' in target, limit given {max_partitions}')
            WHEN mismatching_groups > 0 THEN concat('groups that differ: ', mismatching_groups,
                ', first ', least(mismatching_groups, {SHOWN_EXAMPLES}), ': ', examples) END"""
    else:
        partition_ok = "false" if missing else "CAST(NULL AS BOOLEAN)"
        partition_detail = "CAST(NULL AS STRING)"
    fixed = schema_found + [f"no such partition column on both sides: {key}" for key in missing]
    printed = "coalesce(CAST({} AS STRING), 'None')".format
    global_detail = f"""CASE WHEN NOT ({TOTALS_MATCH}) THEN concat(
        'contents differ: rows ', source_rows, '/', target_rows,
        '; hash_a ', {printed('source_hash_a')}, '/', {printed('target_hash_a')},
        '; hash_b ', {printed('source_hash_b')}, '/', {printed('target_hash_b')}) END"""
    found = f"array_compact(array({partition_detail}, {global_detail}))"
    verdict = totals.selectExpr(
        "source_rows",
        "target_rows",
        f"{TOTALS_MATCH} AS global_hash_ok",
        f"{partition_ok} AS partition_ok",
        f"{found} AS found",
    )
    return verdict.select(
        F.expr("global_hash_ok AND coalesce(partition_ok, true)" + " AND false" * bool(schema_found)).alias("ok"),
        "source_rows",
        "target_rows",
        F.lit(not schema_found).alias("schema_ok"),
        "global_hash_ok",
        "partition_ok",
        F.concat(F.array(*map(F.lit, fixed)).cast("array<string>"), "found").alias("details"),
    )
