"""Interrupted runs: each change of the catalogue is stopped after every one of its steps, and recovered.

A session that ends after a given step stands for a process that is killed there: nothing after that step
runs, no handler of errors either. What comes back for each stop is what recovery found, the state it ended in, what a
second recovery did, and the contents of the table that users read.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayout.operators import publish as P
from relayout.operators.rewrite import rewrite_table
from relayout.plans.migrate import compact_table
from relayout.plans.recover import recover
from relayout.sources.catalog import partition_places
from relayout.sources.evidence import EvidenceFile
from workload.fixtures import load
from workload.lifecycle import Scratch, scratch


class Killed(BaseException):
    """Not an Exception: no handler of the library may tidy up."""


class Ending:
    """A session that ends after a number of steps: catalogue changes and journal records."""

    def __init__(self, spark: SparkSession, last: int):
        self.spark, self.last, self.steps = spark, last, 0
        self.lock = threading.Lock()

    def __getattr__(self, name: str) -> object:
        return getattr(self.spark, name)

    def _step(self, change: Callable[[], object]) -> object:
        with self.lock:
            if self.steps >= self.last:
                raise Killed
            done = change()
            self.steps += 1
            if self.steps == self.last:
                raise Killed
            return done

    def sql(self, text: str) -> DataFrame:
        if text.split(" ", 1)[0] in ("ALTER", "CREATE", "DROP"):
            return self._step(lambda: self.spark.sql(text))
        return self.spark.sql(text)

    def recorder(self, journal: str, table: str) -> P.Record:
        file = EvidenceFile(self.spark, journal, "RUN-1")
        return lambda state, **extras: self._step(lambda: file.event(table, state, **extras))


Change = Callable[[SparkSession, P.Record], None]


def _swap(work: Scratch) -> tuple[Change, Change]:
    table, staging, legacy = (work.table(name) for name in ("t", "t__ice", "t__legacy"))
    work.copy("customer", "t", "c_mktsegment")
    rewrite_table(work.spark, table, staging)
    return (
        lambda spark, record: P.swap(spark, table, staging, legacy, record),
        lambda spark, record: P.undo_swap(spark, table, legacy, staging, record),
    )


def _undo_swap(work: Scratch) -> tuple[Change, Change]:
    forth, back = _swap(work)
    forth(work.spark, P.no_record)
    return back, forth


def _convert(work: Scratch) -> tuple[Change, Change]:
    table = work.external("customer", "t", "c_mktsegment")
    backup = f"{table}_BACKUP_"
    return (
        lambda spark, record: P.convert_in_place(spark, table, backup, "", record),
        lambda spark, record: P.undo_in_place(spark, table, backup, record),
    )


def _undo_convert(work: Scratch) -> tuple[Change, Change]:
    forth, back = _convert(work)
    forth(work.spark, P.no_record)
    return back, forth


def _switch(work: Scratch) -> tuple[Change, Change]:
    """The switch to files that a compaction has packed and proved."""
    table = work.table("t")
    load(work.spark, work.sf, "customer").repartition(3).write.partitionBy("c_mktsegment").saveAsTable(table)
    before = dict(partition_places(work.spark, table))
    compact_table(work.spark, table)
    place = next(iter(partition_places(work.spark, table)))
    folder = place[1].removesuffix(f"/{place[0]}")
    P.set_places(work.spark, table, before)
    return (
        lambda spark, record: P.switch_partitions(spark, table, before, folder, record),
        lambda spark, record: P.set_places(spark, table, before),
    )


# By operation: how it and its way back are prepared, the steps it takes over a table of five partitions, and its
# states when completed and when undone.
OPERATIONS = {
    "swap": (_swap, 5, "PUBLISHED", "UNPUBLISHED"),
    "undo_swap": (_undo_swap, 4, "NAMES_RESTORED", "STILL_PUBLISHED"),
    "convert": (_convert, 5, "CONVERTED", "UNCONVERTED"),
    "undo_convert": (_undo_convert, 5, "ENTRY_RESTORED", "STILL_CONVERTED"),
    "switch": (_switch, 7, "COMPACTED", "UNCOMPACTED"),
}
SCHEMA = "operation string, stop bigint, forward boolean, state string, again bigint, n bigint, cents bigint, segments bigint"


def recovered_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Every stop of every operation, completed and undone."""
    return spark.createDataFrame(list(_all_stops(spark, sf)), SCHEMA)


def _all_stops(spark: SparkSession, sf: str) -> Iterator[tuple]:
    for operation, (prepare, steps, *_) in OPERATIONS.items():
        with scratch(spark, sf) as work:
            run, back = prepare(work)
            for stop in range(1, steps + 1):
                for forward in (False, True):
                    journal = f"{work.folder}/_journal_{stop}_{forward}"
                    ending = Ending(spark, stop)
                    with suppress(Killed):
                        run(ending, ending.recorder(journal, work.table("t")))
                    first = recover(spark, journal, forward).collect()
                    again = recover(spark, journal, forward).count()
                    rows = spark.table(work.table("t")).agg(
                        F.count(F.lit(1)), F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")),
                        F.count_distinct("c_mktsegment"),
                    )
                    yield (operation, stop, forward, first[0]["state"] if first else "OVER", again, *rows.first())
                    if forward or not first:  # as it was, for the next stop
                        back(spark, P.no_record)


QUERIES = {"recovered_stops": recovered_stops}


def _sql() -> str:
    rows = []
    for operation, (_, steps, done, undone) in OPERATIONS.items():
        for stop in range(1, steps + 1):
            for forward in (True, False):
                state = done if forward else undone
                if stop == steps:  # after its end nothing is open
                    state = "OVER"
                rows.append(f"('{operation}', {stop}, {str(forward).lower()}, '{state}')")
    return f"""SELECT operation, CAST(stop AS BIGINT) AS stop, forward, state, CAST(0 AS BIGINT) AS again, n, cents, segments
        FROM (VALUES {", ".join(rows)}) AS t(operation, stop, forward, state),
        (SELECT count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents,
                count(DISTINCT c_mktsegment) AS segments FROM customer)"""


ORACLE = {"recovered_stops": _sql()}
