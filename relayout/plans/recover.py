"""Recovery of interrupted runs from the journal.

Each change of the catalogue is recorded twice: what is intended, before its first step, and that it is done, after its
last. An intention without its end was interrupted. Which of its steps were done is not guessed from the journal but
seen in the catalogue, where every step leaves a mark of its own: names that exist, places of partitions. From there the
rest is done or what was done is undone, by the same steps, each of which does nothing where it was done before. A
recovery that is itself interrupted is recovered by the next one; one that finds nothing open changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayout.operators import publish as P
from relayout.plans.migrate import new_run_id
from relayout.sources.catalog import partition_places, table_exists
from relayout.sources.evidence import EvidenceFile, read_journal

RECOVERED_SCHEMA = "table string, operation string, found string, state string"


@dataclass(frozen=True)
class Operation:
    """How an operation ends; ``states`` are its names when done and when undone."""

    ends: tuple[str, ...]
    states: tuple[str, str]


OPERATIONS = {
    "swap": Operation(("TARGET_RENAMED",), ("PUBLISHED", "UNPUBLISHED")),
    "undo_swap": Operation(("NAMES_RESTORED",), ("NAMES_RESTORED", "STILL_PUBLISHED")),
    "convert": Operation(("MIGRATED",), ("CONVERTED", "UNCONVERTED")),
    "undo_convert": Operation(("ENTRY_RESTORED",), ("ENTRY_RESTORED", "STILL_CONVERTED")),
    "switch": Operation(("PARTITIONS_SWITCHED",), ("COMPACTED", "UNCOMPACTED")),
}
INTENTS = {
    "MOVES_INTENDED": "", "CONVERSION_INTENDED": "convert", "RESTORATION_INTENDED": "undo_convert",
    "SWITCH_INTENDED": "switch",
}
# An undone operation is over too.
_ENDS = ("CUTOVER_AUTO_ROLLED_BACK", "RECOVERED", *(end for one in OPERATIONS.values() for end in one.ends))


def open_operations(journal: DataFrame) -> DataFrame:
    """table, state and extras of each table's last intention, where nothing ended it."""
    known = journal.where(F.col("state").isin(*INTENTS, *_ENDS))
    last = known.groupBy("table").agg(F.max_by(F.struct("state", "extras", "run_id"), F.col("seq")).alias("last"))
    return last.select("table", "last.*").where(F.col("state").isin(*INTENTS))


def recover(spark: SparkSession, journal: str, forward: bool = True, run_id: str = "") -> DataFrame:
    """Complete (or undo) every interrupted operation of a journal: table, operation, what was found, and the end state.

    The operations are few, as each was one running table; the loop is on the driver because each changes the catalogue.
    """
    run_id = run_id or new_run_id()
    rows = []
    for row in open_operations(read_journal(spark, journal)).orderBy("table").collect():
        table, extras = row["table"], row["extras"]
        operation = INTENTS[row["state"]] or extras["operation"]
        found, mend = _STEPS[operation](spark, table, extras)
        mend(forward)
        state = OPERATIONS[operation].states[0 if forward else 1]
        EvidenceFile(spark, journal, run_id).event(table, "RECOVERED", operation=operation, found=found, to=state)
        rows.append((table, operation, found, state))
    return spark.createDataFrame(rows, RECOVERED_SCHEMA)


def _moves(spark: SparkSession, table: str, extras: dict) -> tuple[str, Callable[[bool], None]]:
    """Two renames, the second to the name that the first one frees."""
    moves = [tuple(move) for move in json.loads(extras["moves"])]
    (_, aside, _), (coming, _, _) = moves
    done = 0 if not table_exists(spark, aside) else 1 if table_exists(spark, coming) else 2

    def mend(forward: bool) -> None:
        for old, new, place in moves[:done]:  # a rename whose partitions may not have followed
            P.follow_rename(spark, new, place)
        if forward:
            for old, new, _ in moves[done:]:
                P.moved(spark, old, new)
        else:
            for old, new, _ in reversed(moves[:done]):
                P.moved(spark, new, old)

    return f"{done} of 2 renames", mend


def _conversion(spark: SparkSession, table: str, extras: dict) -> tuple[str, Callable[[bool], None]]:
    backup, fmt, place = extras["backup"], extras["fmt"], extras["location"]
    named, kept = table_exists(spark, table), table_exists(spark, backup)

    def mend(forward: bool) -> None:
        if kept:
            P.follow_rename(spark, backup, place)
        if forward:
            if not kept:
                P.moved(spark, table, backup)
            if named and kept:
                P.complete_share(spark, backup, table)
            else:
                P.share_files(spark, backup, table, fmt)
        elif kept:
            if named:
                P.drop_entry(spark, table)
            P.moved(spark, backup, table)

    return "not begun" if not kept else "entry there" if named else "renamed", mend


def _restoration(spark: SparkSession, table: str, extras: dict) -> tuple[str, Callable[[bool], None]]:
    backup = extras["backup"]
    named, kept = table_exists(spark, table), table_exists(spark, backup)

    def mend(forward: bool) -> None:
        if forward:
            if named and kept:
                P.drop_entry(spark, table)
            if kept:
                P.moved(spark, backup, table)
        else:
            if not kept:
                P.moved(spark, table, backup)
            if not (named and kept):
                P.share_files(spark, backup, table)

    return "done" if not kept else "not begun" if named else "entry dropped", mend


def _switch(spark: SparkSession, table: str, extras: dict) -> tuple[str, Callable[[bool], None]]:
    places, folder = json.loads(extras["places"]), extras["folder"]
    now = dict(partition_places(spark, table))
    switched = sum(now.get(shown, "").rstrip("/").endswith(f"{folder}/{shown}".split(":", 1)[-1]) for shown in places)

    def mend(forward: bool) -> None:
        wanted = {shown: f"{folder}/{shown}" for shown in places} if forward else places
        P.set_places(spark, table, {shown: place for shown, place in wanted.items() if shown in now})

    return f"{switched} of {len(places)} partitions", mend


_STEPS: dict[str, Callable] = {
    "swap": _moves, "undo_swap": _moves, "convert": _conversion, "undo_convert": _restoration, "switch": _switch,
}
