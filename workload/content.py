"""Checks of the content comparison. Answers are verdicts and counts, never hash values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayout.functions.canonical import canonical_rows as as_text
from relayout.functions.fingerprint import row_hashes
from relayout.operators import compare as C
from relayout.operators import drilldown
from workload.fixtures import as_sql, load

LINE_KEYS = ["l_returnflag", "l_linestatus"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _verdict(scenario: str, source: DataFrame, target: DataFrame) -> DataFrame:
    totals = C.content_totals(C.compare_contents(source, target))
    return totals.select(
        F.lit(scenario).alias("scenario"),
        "source_rows",
        "target_rows",
        F.expr(C.TOTALS_MATCH).alias("equal"),
    )


def _verdict_sql(scenario: str, source: str, target: str) -> str:
    """Two tables are equal if neither has a row, counted with repetitions, that the other lacks."""
    return f"""SELECT '{scenario}' AS scenario,
        (SELECT count(*) FROM ({source})) AS source_rows,
        (SELECT count(*) FROM ({target})) AS target_rows,
        NOT EXISTS (SELECT * FROM ({source}) EXCEPT ALL SELECT * FROM ({target}))
        AND NOT EXISTS (SELECT * FROM ({target}) EXCEPT ALL SELECT * FROM ({source})) AS equal"""


def _verdicts_sql(*scenarios: tuple[str, str, str]) -> str:
    return as_sql("\nUNION ALL\n".join(_verdict_sql(*scenario) for scenario in scenarios))


def fingerprint_verdict(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = load(spark, sf, "lineitem")
    return _union(
        [
            _verdict("reordered", lineitem, load(spark, sf, "lineitem_reordered")),
            _verdict("changed", lineitem, load(spark, sf, "lineitem_bad")),
        ]
    )


def _lineitem_compared(spark: SparkSession, sf: str) -> DataFrame:
    return C.compare_contents(
        load(spark, sf, "lineitem"), load(spark, sf, "lineitem_bad"), LINE_KEYS
    )


def _rows_of_both(compared: DataFrame, *keys: str) -> DataFrame:
    return compared.select(
        *keys,
        F.col("source_row_count").alias("source_rows"),
        F.col("target_row_count").alias("target_rows"),
        "matches",
    )


def fingerprint_by_partition(spark: SparkSession, sf: str) -> DataFrame:
    return _rows_of_both(_lineitem_compared(spark, sf), *LINE_KEYS)


def fingerprint_multiplicity(spark: SparkSession, sf: str) -> DataFrame:
    once, twice = load(spark, sf, "mult_a"), load(spark, sf, "mult_b")
    return _union([_verdict("other_copy", once, twice), _verdict("same_copy", once, once)])


def fingerprint_empty(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    empty = events.where("event_id < 0")
    return _union([_verdict("both_empty", empty, empty), _verdict("one_empty", events, empty)])


def canonical_negative(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")

    def nested(df: DataFrame) -> DataFrame:
        return df.select(F.struct(*df.columns).alias("nested"))

    def listed(df: DataFrame) -> DataFrame:
        return df.select(F.array(F.struct(*df.columns)).alias("nested"))

    def mapped(df: DataFrame, *names: str) -> DataFrame:
        entries = [part for name in names for part in (F.lit(name), F.col(name))]
        return df.select("event_id", F.create_map(*entries).alias("entries"))

    moved = load(spark, sf, "events_us")
    return _union(
        [
            _verdict("nested_microsecond", nested(events), nested(moved)),
            _verdict("listed_microsecond", listed(events), listed(moved)),
            _verdict("swapped_cells", events, load(spark, sf, "events_swap")),
            _verdict("null_marker", load(spark, sf, "marker_null"), load(spark, sf, "marker_text")),
            _verdict(
                "map_entry_order",
                mapped(events, "event_type", "props"),
                mapped(events, "props", "event_type"),
            ),
        ]
    )


def canonical_rows(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events")
    entries = [part for name in events.columns for part in (F.lit(name), F.col(name).cast("string"))]
    inputs = {
        "array": load(spark, sf, "embeddings"),
        "struct": events.select(F.struct(*events.columns).alias("v")),
        "map": events.select(F.create_map(*entries).alias("v")),
        "flat": events,
    }

    def counted(scenario: str, df: DataFrame) -> DataFrame:
        """Distinct rows by text and by value; 16 bytes per row are shuffled, not the rows."""
        texts = as_text(df)
        marked = [F.coalesce(name, F.lit("")) for name in texts.columns]
        marked += [F.col(name).isNull() for name in texts.columns]
        by_text = texts.select(
            F.xxhash64(*marked).alias("hash_a"), F.xxhash64(F.lit("text"), *marked).alias("hash_b")
        )
        sides = [by_text.withColumn("side", F.lit("text")), row_hashes(df).withColumn("side", F.lit("value"))]
        rows = sides[0].unionByName(sides[1]).groupBy("side", "hash_a", "hash_b").count()
        in_side = lambda side, value: F.sum(F.when(F.col("side") == side, value)).cast("bigint")
        return rows.agg(
            F.lit(scenario).alias("scenario"),
            in_side("value", F.col("count")).alias("n_rows"),
            in_side("text", F.lit(1)).alias("distinct_texts"),
            in_side("value", F.lit(1)).alias("distinct_values"),
        )

    return _union([counted(scenario, df) for scenario, df in inputs.items()])


def partition_diff(spark: SparkSession, sf: str) -> DataFrame:
    compared = _lineitem_compared(spark, sf)
    return _rows_of_both(C.mismatch_examples(compared, LINE_KEYS), *LINE_KEYS)


def differing_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that a damaged copy of lineitem changed, dropped or added."""
    return drilldown.differing_rows(load(spark, sf, "lineitem"), load(spark, sf, "lineitem_bad"), LINE_KEYS)


def partition_diff_nullkey(spark: SparkSession, sf: str) -> DataFrame:
    source = load(spark, sf, "events_nullkey")

    def scenario(name: str, target: DataFrame) -> DataFrame:
        found = C.mismatches(C.compare_contents(source, target, ["event_type"]))
        return _rows_of_both(found, "event_type").withColumn("scenario", F.lit(name))

    return scenario("same", source).unionByName(
        scenario("changed", load(spark, sf, "events_nullkey_bad"))
    )


def partition_mismatch_count(spark: SparkSession, sf: str) -> DataFrame:
    return C.content_totals(_lineitem_compared(spark, sf)).select("mismatching_groups")


def partition_guard(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders")
    totals = C.content_totals(C.compare_contents(orders, orders, ["o_orderdate"]))
    limits = F.explode(F.array(F.lit(10), F.lit(10_000))).alias("max_partitions")
    counted = totals.select("source_groups", "target_groups", limits)
    refused = F.greatest("source_groups", "target_groups") > F.col("max_partitions")
    return counted.withColumn("refused", refused)


def validate_tables(spark: SparkSession, sf: str) -> DataFrame:
    customer, segment = load(spark, sf, "customer"), ["c_mktsegment"]
    lineitem = load(spark, sf, "lineitem")
    verdicts = {
        "smaller_integer": C.validate(customer, load(spark, sf, "customer_small"), segment),
        "renamed": C.validate(customer, load(spark, sf, "customer_renamed"), segment),
        "retyped": C.validate(customer, load(spark, sf, "customer_retyped")),
        "changed": C.validate(lineitem, load(spark, sf, "lineitem_bad"), LINE_KEYS),
        "no_such_key": C.validate(lineitem, lineitem, ["l_shipmode"]),
        "too_many_groups": C.validate(lineitem, lineitem, ["l_shipdate"], 10),
    }
    return _union(
        [
            verdict.select(
                F.lit(scenario).alias("scenario"), "ok", "source_rows", "target_rows", "schema_ok",
                "global_hash_ok", "partition_ok", F.size("details").alias("n_details"),
            )
            for scenario, verdict in verdicts.items()
        ]
    )


QUERIES = {
    "fingerprint_verdict": fingerprint_verdict,
    "fingerprint_by_partition": fingerprint_by_partition,
    "fingerprint_multiplicity": fingerprint_multiplicity,
    "fingerprint_empty": fingerprint_empty,
    "canonical_negative": canonical_negative,
    "canonical_rows": canonical_rows,
    "partition_diff": partition_diff,
    "partition_diff_nullkey": partition_diff_nullkey,
    "differing_rows": differing_rows,
    "partition_mismatch_count": partition_mismatch_count,
    "partition_guard": partition_guard,
    "validate_tables": validate_tables,
}

_CHANGED_GROUPS = """
    WITH diff AS (
        (SELECT * FROM {lineitem} EXCEPT ALL SELECT * FROM {lineitem_bad})
        UNION ALL
        (SELECT * FROM {lineitem_bad} EXCEPT ALL SELECT * FROM {lineitem})
    ),
    changed AS (SELECT DISTINCT l_returnflag, l_linestatus FROM diff),
    source AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ALL),
    target AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem_bad} GROUP BY ALL),
    compared AS (
        SELECT l_returnflag, l_linestatus, s.n AS source_rows, t.n AS target_rows,
               c.l_returnflag IS NULL AS matches
        FROM source s FULL JOIN target t USING (l_returnflag, l_linestatus)
        LEFT JOIN changed c USING (l_returnflag, l_linestatus)
    )"""

_EVENTS = "SELECT * FROM {events}"
_MOVED_TS = _EVENTS, "SELECT * FROM {events_us}"


def _distinct_sql(scenario: str, rows: str) -> str:
    return f"""SELECT '{scenario}' AS scenario, (SELECT count(*) FROM ({rows})) AS n_rows,
        (SELECT count(*) FROM (SELECT DISTINCT * FROM ({rows}))) AS distinct_texts,
        (SELECT count(*) FROM (SELECT DISTINCT * FROM ({rows}))) AS distinct_values"""


ORACLE = {
    "differing_rows": as_sql(
        " UNION ALL ".join(
            f"""SELECT '{side}' AS side, count(*) AS copies, d.*
            FROM (SELECT * FROM {{{one}}} EXCEPT ALL SELECT * FROM {{{other}}}) d GROUP BY ALL"""
            for side, one, other in (("source", "lineitem", "lineitem_bad"), ("target", "lineitem_bad", "lineitem"))
        )
    ),
    "fingerprint_verdict": _verdicts_sql(
        ("reordered", "SELECT * FROM {lineitem}", "SELECT * FROM {lineitem_reordered}"),
        ("changed", "SELECT * FROM {lineitem}", "SELECT * FROM {lineitem_bad}"),
    ),
    "fingerprint_by_partition": as_sql(_CHANGED_GROUPS + " SELECT * FROM compared"),
    "fingerprint_multiplicity": _verdicts_sql(
        ("other_copy", "SELECT * FROM {mult_a}", "SELECT * FROM {mult_b}"),
        ("same_copy", "SELECT * FROM {mult_a}", "SELECT * FROM {mult_a}"),
    ),
    "fingerprint_empty": _verdicts_sql(
        ("both_empty", _EVENTS + " WHERE event_id < 0", _EVENTS + " WHERE event_id < 0"),
        ("one_empty", _EVENTS, _EVENTS + " WHERE event_id < 0"),
    ),
    "canonical_negative": _verdicts_sql(
        ("nested_microsecond", *_MOVED_TS),
        ("listed_microsecond", *_MOVED_TS),
        ("swapped_cells", _EVENTS, "SELECT * FROM {events_swap}"),
        ("null_marker", "SELECT * FROM {marker_null}", "SELECT * FROM {marker_text}"),
        ("map_entry_order", _EVENTS, _EVENTS),
    ),
    "canonical_rows": as_sql(
        " UNION ALL ".join(
            [
                _distinct_sql("array", "SELECT * FROM {embeddings}"),
                *[
                    _distinct_sql(s, _EVENTS)
                    for s in ("struct", "map", "flat")
                ],
            ]
        )
    ),
    "partition_diff": as_sql(
        _CHANGED_GROUPS
        + " SELECT * FROM compared WHERE NOT matches"
    ),
    "partition_diff_nullkey": as_sql(
        """SELECT 'changed' AS scenario, event_type, count(*) AS source_rows, count(*) AS target_rows,
                  false AS matches
           FROM {events_nullkey} WHERE event_type IS NULL GROUP BY event_type"""
    ),
    "partition_mismatch_count": as_sql(
        _CHANGED_GROUPS + " SELECT count(*) AS mismatching_groups FROM compared WHERE NOT matches"
    ),
    "partition_guard": as_sql(
        """SELECT d AS source_groups, d AS target_groups, m AS max_partitions, d > m AS refused
           FROM (SELECT count(DISTINCT o_orderdate) AS d FROM {orders}),
                (SELECT unnest([10, 10000])::INTEGER AS m)"""
    ),
    "validate_tables": as_sql(
        """WITH c AS (SELECT count(*) AS n FROM {customer}), l AS (SELECT count(*) AS n FROM {lineitem}),
                b AS (SELECT count(*) AS n FROM {lineitem_bad})
        SELECT 'smaller_integer' AS scenario, true AS ok, n AS source_rows, n AS target_rows,
               true AS schema_ok, true AS global_hash_ok, true AS partition_ok, 0 AS n_details FROM c
        UNION ALL SELECT 'renamed', false, n, n, false, true, true, 1 FROM c
        UNION ALL SELECT 'retyped', false, n, n, false, true, NULL, 1 FROM c
        UNION ALL SELECT 'changed', false, l.n, b.n, true, false, false, 2 FROM l, b
        UNION ALL SELECT 'no_such_key', false, n, n, true, true, false, 1 FROM l
        UNION ALL SELECT 'too_many_groups', false, n, n, true, true, false, 1 FROM l"""
    ),
}
