"""From catalogue rows to plan rows: table kind, file format, strategy and plan shape."""

from __future__ import annotations

from pyspark.sql import DataFrame

from relayout.functions.datatypes import column_blockers, column_casts

# Plan columns, strategies and the notes that explain them.
PLAN_FIELDS = (
    "table", "source_type", "strategy", "approved", "writer_freeze_ticket", "format",
    "schema_compatible", "cast_columns", "partitions", "target_partition_spec", "location",
    "target_location", "size_gb", "files", "avg_file_mb", "compact", "target_format_version", "note",
)
FORMATS = ("parquet", "orc", "avro")
NOTE_VIEW = "view"
NOTE_ALREADY = "already in the target format"
NOTE_ACID = "Hive ACID; execute through approved Hive/HWC procedure"
NOTE_BUCKETS = "bucketed Hive layout requires rewrite"
NOTE_KIND = " table is not eligible for in-place migrate"
NOTE_CASTS = "schema conversion required"
NOTE_AVRO = "rewrite Avro to Parquet for broad Impala compatibility"
NOTE_FORMAT = "source file format requires rewrite"
NOTE_TRANSLATED = "TRANSLATED_TO_EXTERNAL must be reviewed before migrate"
NOTE_ELIGIBLE = "external non-ACID table eligible for pilot validation"
TARGET_VERSION = "2"

_NUMERIC_PLAN_FIELDS = {"size_gb": "double", "files": "bigint", "avg_file_mb": "double"}
_SIZE_FIELDS = (*_NUMERIC_PLAN_FIELDS, "compact")


def _first_true(rules: list[tuple[str, str]], otherwise: str) -> str:
    cases = " ".join(f"WHEN {condition} THEN {value}" for condition, value in rules)
    return f"CASE {cases} ELSE {otherwise} END"


def source_kind() -> str:
    raw = "upper(coalesce(type_raw, ''))"
    known = [(f"contains({raw}, '{kind}')", f"'{kind}'") for kind in ("EXTERNAL", "MANAGED", "VIEW")]
    return _first_true(known + [(f"{raw} = ''", "'UNKNOWN'")], raw)


def source_format() -> str:
    described = "lower(concat_ws(' ', provider, serde, input_format))"
    return _first_true([(f"contains({described}, '{f}')", f"'{f}'") for f in FORMATS], "'other'")


def _strategy(allow_avro_migrate: bool, target_provider: str, target_property: str) -> str:
    """The ordered rules: the first that holds gives the strategy and its note."""
    properties = "lower(coalesce(table_properties, ''))"
    bucketed = r"rlike(num_buckets, '^[0-9]+$') AND try_cast(num_buckets AS DECIMAL(38,0)) > 0"
    there = []
    if target_provider:
        there.append(f"lower(provider) = lower('{target_provider}')")
    if target_property:
        there.append(f"contains({properties}, lower('{target_property}'))")
    rules = [
        ("source_type = 'VIEW'", "skip", f"'{NOTE_VIEW}'"),
        (" OR ".join(there) or "false", "skip", f"'{NOTE_ALREADY}'"),
        (f"contains({properties}, 'transactional=true')", "hive_ctas", f"'{NOTE_ACID}'"),
        ("size(blockers) > 0", "manual", "array_join(blockers, '; ')"),
        (bucketed, "ctas", f"'{NOTE_BUCKETS}'"),
        ("source_type <> 'EXTERNAL'", "ctas", f"concat(source_type, '{NOTE_KIND}')"),
        ("size(casts) > 0", "ctas", f"'{NOTE_CASTS}'"),
        (f"format = 'avro' AND {not allow_avro_migrate}", "ctas", f"'{NOTE_AVRO}'"),
        ("format = 'other'", "ctas", f"'{NOTE_FORMAT}'"),
        (f"contains({properties}, 'translated_to_external=true')", "manual", f"'{NOTE_TRANSLATED}'"),
    ]

    def outcome(strategy: str, note: str) -> str:
        return f"struct('{strategy}' AS strategy, {note} AS note)"

    cases = [(condition, outcome(strategy, note)) for condition, strategy, note in rules]
    failed = outcome("manual", "concat('inventory error: ', error)")
    return _first_true(
        [("error IS NOT NULL", failed), *cases], outcome("migrate", f"'{NOTE_ELIGIBLE}'")
    )


def type_actions(catalog: DataFrame) -> DataFrame:
    """Add the casts a table needs and the reasons that forbid converting it."""
    return catalog.selectExpr(
        "*", f"{column_casts('columns')} AS casts", f"{column_blockers('columns')} AS blockers"
    )


def classify(
    catalog: DataFrame,
    allow_avro_migrate: bool = False,
    target_provider: str = "",
    target_property: str = "",
) -> DataFrame:
    """Add kind, format, casts, blockers, strategy and note to catalogue rows.

    A table of ``target_provider``, or with the ``name=value`` property, needs no migration.
    A row whose inspection failed keeps its error and is left to manual review.
    """
    prepared = type_actions(catalog).selectExpr(
        "*", f"{source_kind()} AS source_type", f"{source_format()} AS format"
    )
    decided = prepared.selectExpr("*", f"{_strategy(allow_avro_migrate, target_provider, target_property)} AS decided")
    return decided.selectExpr("* EXCEPT (decided)", "decided.strategy", "decided.note")


def plan_rows(classified: DataFrame) -> DataFrame:
    """Shape classified tables into plan rows without sizes; every row starts unapproved.

    A table that could not be inspected has blanks but for its note.
    """
    inspected = {
        "source_type": "source_type",
        "format": "format",
        "schema_compatible": "if(size(blockers) = 0, 'Y', 'N')",
        "cast_columns": "array_join(transform(casts, c -> concat(c.name, ':', c.dtype)), ';')",
        "partitions": "array_join(partitions, ';')",
        "target_partition_spec": "array_join(partitions, ';')",
        "location": "location",
        "target_format_version": f"'{TARGET_VERSION}'",
    }
    shaped = classified.selectExpr(
        "table_name AS table",
        "strategy",
        "'N' AS approved",
        "note",
        *[f"CASE WHEN error IS NULL THEN {value} END AS {name}" for name, value in inspected.items()],
    )
    return plan_fields(shaped)


def with_sizes(plan: DataFrame, sizes: DataFrame, every_table: bool = False) -> DataFrame:
    """Fill in ``size_gb``, ``files``, ``avg_file_mb`` and ``compact`` by ``table_name``.

    Only tables with work to do carry sizes, unless every table with a location should.
    """
    return plan_fields(join_sizes(plan, sizes.select("table_name", *_SIZE_FIELDS), every_table))


def join_sizes(plan: DataFrame, sizes: DataFrame, every_table: bool) -> DataFrame:
    """Plan rows with sizes and with whatever else ``sizes`` tells about a table."""
    measured = "location <> ''"
    if not every_table:
        measured += " AND strategy NOT IN ('skip', 'manual')"
    numbers = [f"CASE WHEN {measured} THEN {name} END AS {name}" for name in _NUMERIC_PLAN_FIELDS]
    judged = f"CASE WHEN {measured} THEN coalesce(compact, '') ELSE '' END AS compact"
    return (
        plan.drop(*_SIZE_FIELDS)
        .join(sizes.withColumnRenamed("table_name", "table"), "table", "left")
        .selectExpr(f"* EXCEPT ({', '.join(_SIZE_FIELDS)})", *numbers, judged)
    )


def plan_fields(rows: DataFrame) -> DataFrame:
    """Exactly the plan columns, in order; absent text is blank, absent numbers are NULL."""

    def value(name: str) -> str:
        present = name if name in rows.columns else "NULL"
        number = _NUMERIC_PLAN_FIELDS.get(name)
        if number:
            return f"CAST({present} AS {number}) AS {name}"
        return f"coalesce(CAST({present} AS STRING), '') AS `{name}`"

    return rows.selectExpr(*map(value, PLAN_FIELDS))
