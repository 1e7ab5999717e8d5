"""Publication by renaming, in-place conversion over the same files, and the ways back.

Two renames are not atomic: between them the published name does not exist. What will be done is recorded before
the first step and that it was done after the last, so ``relayout.plans.recover`` completes or undoes a run that was
interrupted anywhere between.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress

from pyspark.sql import SparkSession

from relayout.functions.naming import quoted, quoted_table
from relayout.sources.catalog import (
    describe_table,
    partition_locations,
    partition_spec,
    table_exists,
    text,
)

Record = Callable[..., None]

# Properties that belong to one table entry.
_OWN_PROPERTIES = frozenset(
    {"EXTERNAL", "transient_lastDdlTime", "last_modified_by", "last_modified_time", "numFiles",
     "numPartitions", "numRows", "rawDataSize", "totalSize", "COLUMN_STATS_ACCURATE", "bucketing_version"}
)
_PARTITIONS_PER_CALL = 500


def no_record(state: str, **extras: object) -> None:
    pass


def switch_partitions(
    spark: SparkSession, table: str, places: dict[str, str], folder: str, record: Record = no_record, calls: int = 8
) -> None:
    """Let partitions be read from below ``folder``, laid out as partitioned writes do.

    ``places``: where each is now, by its name as SHOW PARTITIONS prints it, which Spark's folders have too. All
    are recorded before the first one changes, in one record, and once more when all have.
    """
    record("SWITCH_INTENDED", folder=folder, places=json.dumps(places))
    set_places(spark, table, {shown: f"{folder}/{shown}" for shown in places}, calls)
    record("PARTITIONS_SWITCHED", folder=folder, partitions=len(places))


def set_places(spark: SparkSession, table: str, places: dict[str, str], calls: int = 8) -> None:
    """Set where partitions are stored, some at a time; a place set twice stays as it is."""

    def switch(one: tuple[str, str]) -> None:
        spec = partition_spec(one[0])
        spark.sql(f"ALTER TABLE {quoted_table(table)} PARTITION ({spec}) SET LOCATION {text(one[1])}")

    with ThreadPoolExecutor(calls) as pool:
        list(pool.map(switch, places.items()))


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Rename a table. ``follow_rename`` is its second part."""
    spark.sql(f"ALTER TABLE {quoted_table(old)} RENAME TO {quoted_table(new)}")


def follow_rename(spark: SparkSession, table: str, before: str) -> None:
    """Make the partitions follow where the catalogue moved a renamed table's folder but not their entries.

    ``before``: where the table was. Only entries below it change; none is added or dropped, and one
    partition is looked at where the catalogue has done the work itself.
    """
    described = describe_table(spark, table)
    after = described["location"].rstrip("/")
    before = before.rstrip("/")
    if not described["partitions"] or after == before:
        return
    first = spark.sql(f"SHOW PARTITIONS {quoted_table(table)}").head()
    if first is None:
        return
    for spec, location in partition_locations(spark, table).items():
        if location.startswith(f"{before}/"):
            moved = (after + location[len(before) :]).replace("'", "\\'")
            spark.sql(f"ALTER TABLE {quoted_table(table)} PARTITION ({spec}) SET LOCATION '{moved}'")


def moved(spark: SparkSession, old: str, new: str) -> None:
    """Rename a table and its partitions' places; a failure after the rename takes it back."""
    before = describe_table(spark, old)["location"]
    rename(spark, old, new)
    try:
        follow_rename(spark, new, before)
    except Exception:
        now = describe_table(spark, new)["location"] if table_exists(spark, new) else before
        rename(spark, new, old)
        with suppress(Exception):
            follow_rename(spark, old, now)
        raise


def _need_both(spark: SparkSession, first: str, second: str) -> None:
    if not (table_exists(spark, first) and table_exists(spark, second)):
        raise RuntimeError(f"nothing to put back: {first} and {second} must both exist")


def create_namespace(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {quoted(name)}")


def swap(
    spark: SparkSession, source: str, target: str, legacy: str, record: Record = no_record
) -> None:
    """Give ``target`` the name of ``source``, which lives on as ``legacy``.

    If any step after the first rename fails, the journal's included, both tables get their names back.
    """
    if table_exists(spark, legacy):
        raise RuntimeError(f"no cutover while an earlier legacy table is there: {legacy}")
    _intend(spark, record, "swap", [(source, legacy), (target, source)])
    _first_step(lambda: moved(spark, source, legacy), spark, record)
    published = False
    try:
        record("SOURCE_RENAMED", legacy=legacy)
        moved(spark, target, source)
        published = True
        record("TARGET_RENAMED", target=target)
    except Exception as failure:
        _names_back(spark, [(source, target)] * published + [(legacy, source)], record, failure)
        raise


def _names_back(
    spark: SparkSession, renames: list[tuple[str, str]], record: Record, failure: Exception
) -> None:
    """Undo renames, in order; what cannot be undone or recorded is noted on the failure, which stays the error."""
    for now, then in renames:
        try:
            if table_exists(spark, now) and not table_exists(spark, then):
                moved(spark, now, then)
        except Exception as second:
            failure.add_note(f"{now} could not be named {then} again: {second}")
    try:
        record("CUTOVER_AUTO_ROLLED_BACK", error=failure)
    except Exception as second:
        failure.add_note(f"the way back is not recorded: {second}")


def _intend(spark: SparkSession, record: Record, operation: str, renames: list[tuple[str, str]]) -> None:
    """Record renames, in order, with where each table is now, before the first one."""
    moves = [(old, new, describe_table(spark, old)["location"]) for old, new in renames]
    record("MOVES_INTENDED", operation=operation, moves=json.dumps(moves))


def _first_step(step: Callable[[], None], spark: SparkSession, record: Record) -> None:
    """A first step that fails leaves nothing to recover, which ends the intention."""
    try:
        step()
    except Exception as failure:
        _names_back(spark, [], record, failure)
        raise


def undo_swap(
    spark: SparkSession, source: str, legacy: str, failed: str, record: Record = no_record
) -> None:
    """Put the legacy table back; the replaced one is kept under ``failed``, never dropped."""
    _need_both(spark, source, legacy)
    _intend(spark, record, "undo_swap", [(source, failed), (legacy, source)])
    _first_step(lambda: moved(spark, source, failed), spark, record)
    try:
        moved(spark, legacy, source)
    except Exception as failure:
        _names_back(spark, [(failed, source)], record, failure)
        raise
    record("NAMES_RESTORED", failed=failed)


def copied_properties(spark: SparkSession, source: str, target: str) -> None:
    """Give ``target`` the properties and comment of ``source``, which CREATE TABLE LIKE leaves out."""
    described = json.loads(spark.sql(f"DESCRIBE EXTENDED {quoted_table(source)} AS JSON").first()[0])
    kept = {
        name: value
        for name, value in described.get("table_properties", {}).items()
        if name not in _OWN_PROPERTIES and not name.startswith("spark.sql.")
    }
    if described.get("comment"):
        kept["comment"] = described["comment"]  # unlike COMMENT ON, this keeps declared CHAR types
    if kept:
        listed = ", ".join(f"{text(name)} = {text(value)}" for name, value in kept.items())
        spark.sql(f"ALTER TABLE {quoted_table(target)} SET TBLPROPERTIES ({listed})")


def share_files(spark: SparkSession, source: str, target: str, fmt: str = "") -> None:
    """Create ``target`` as an external table over the files of ``source``; copies no data.

    Partitions come from the catalogue, so those stored elsewhere are there too; properties and comment
    are kept.
    """
    if table_exists(spark, target):
        raise RuntimeError(f"{target} exists already and is not overwritten")
    described = describe_table(spark, source)
    using = f" USING {quoted(fmt)}" if fmt else ""
    spark.sql(
        f"CREATE TABLE {quoted_table(target)} LIKE {quoted_table(source)}{using}"
        f" LOCATION {text(described['location'])}"
    )
    try:
        complete_share(spark, source, target)
    except Exception:
        spark.sql(f"DROP TABLE {quoted_table(target)}")  # external: an entry without files of its own
        raise


def complete_share(spark: SparkSession, source: str, target: str) -> None:
    """Properties, comment and partitions of ``source`` for an entry over its files; what is there already stays."""
    copied_properties(spark, source, target)
    if describe_table(spark, source)["partitions"]:
        places = list(partition_locations(spark, source).items())
        for start in range(0, len(places), _PARTITIONS_PER_CALL):
            added = " ".join(
                f"PARTITION ({spec}) LOCATION {text(location)}"
                for spec, location in places[start : start + _PARTITIONS_PER_CALL]
            )
            spark.sql(f"ALTER TABLE {quoted_table(target)} ADD IF NOT EXISTS {added}")


def convert_in_place(
    spark: SparkSession, source: str, backup: str, fmt: str = "", record: Record = no_record
) -> None:
    """Re-register an external table under its own name; the old entry stays as ``backup``.

    If a step after the rename fails, the journal's included, the old entry gets its name back.
    """
    if table_exists(spark, backup):
        raise RuntimeError(f"no conversion while an earlier backup is there: {backup}")
    if "EXTERNAL" not in describe_table(spark, source)["type_raw"].upper():
        raise RuntimeError(f"In-place conversion needs an external table: {source}")
    record("CONVERSION_INTENDED", backup=backup, fmt=fmt, location=describe_table(spark, source)["location"])
    _first_step(lambda: moved(spark, source, backup), spark, record)
    try:
        share_files(spark, backup, source, fmt)
        record("MIGRATED", backup=backup)
    except Exception as failure:
        try:
            if table_exists(spark, source):
                spark.sql(f"DROP TABLE {quoted_table(source)}")
        except Exception as second:
            failure.add_note(f"the new entry {source} is still there: {second}")
        _names_back(spark, [(backup, source)], record, failure)
        raise


def undo_in_place(spark: SparkSession, source: str, backup: str, record: Record = no_record) -> None:
    """Drop the converted entry, never its files, and give the backup its name back."""
    _need_both(spark, source, backup)
    record("RESTORATION_INTENDED", backup=backup)
    _first_step(lambda: drop_entry(spark, source), spark, record)
    moved(spark, backup, source)
    record("ENTRY_RESTORED", backup=backup)


def drop_entry(spark: SparkSession, table: str) -> None:
    """Drop an external table's entry, never its files."""
    if "EXTERNAL" not in describe_table(spark, table)["type_raw"].upper():
        raise RuntimeError(f"{table} is managed and is not dropped: that would delete its files")
    spark.sql(f"ALTER TABLE {quoted_table(table)} SET TBLPROPERTIES ('external.table.purge'='false')")
    spark.sql(f"DROP TABLE {quoted_table(table)}")
