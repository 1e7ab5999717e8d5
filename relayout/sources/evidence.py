"""Append-only evidence: state journal and validation records as JSON lines, a folder per run."""

from __future__ import annotations

import itertools
import json
import threading
import time
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayout.sources.store import default_filesystem, delete_file, qualified, write_whole

JOURNAL_SCHEMA = (
    "run_id string, table string, state string, timestamp_utc string, seq bigint, "
    "extras map<string,string>"
)
VALIDATION_STRUCT = (
    "struct<ok:boolean,source_rows:bigint,target_rows:bigint,schema_ok:boolean,"
    "global_hash_ok:boolean,partition_ok:boolean,details:array<string>>"
)
VALIDATION_SCHEMA = (
    f"run_id string, source string, target string, timestamp_utc string, seq bigint, "
    f"validation {VALIDATION_STRUCT}"
)

# Segments of a level that are merged into one of the next.
FAN = 16

_counter = itertools.count()


def _sequence() -> int:
    """Ordered across runs by time, and within a process also where the clock stands still."""
    return (time.time_ns() // 1_000_000) * 100_000 + next(_counter) % 100_000


class EvidenceFile:
    """The records of one writer in one run, in segments that no other writer touches.

    Each record is there, whole, when ``add`` returns: it is a segment of its own, level 0. FAN segments of a level are
    merged into one of the next, so a record is written again once a level, a logarithmic number of times, and a
    writer with n records has some FAN segments a level. A segment's name says which records it holds, ``from-to``;
    merged segments are written before those they replace are deleted, and the deletion waits for the next merge of that level, so a
    reader that has listed them still finds them. A record that a reader sees twice is one record, by writer and number.
    """

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        folder = qualified(path.rstrip("/"), default_filesystem(spark))
        name = quote(run_id, safe="") or "__HIVE_DEFAULT_PARTITION__"
        self.base = f"{folder}/run_id={name}/{uuid.uuid4().hex}"
        self.count = 0
        self.levels: list[list[tuple[int, int, str]]] = []  # first and last record, and the lines
        self.replaced: dict[int, list[str]] = {}  # by level
        self.lock = threading.Lock()

    def _uri(self, first: int, last: int) -> str:
        return f"{self.base}.{first}-{last}.json"

    def add(self, **record: object) -> None:
        now = datetime.now(UTC).isoformat(timespec="microseconds")
        with self.lock:
            number = self.count
            line = json.dumps(
                {**record, "timestamp_utc": now, "seq": _sequence(), "number": number}, ensure_ascii=False
            )
            write_whole(self._uri(number, number), f"{line}\n")
            self.count += 1
            self._put(0, (number, number, f"{line}\n"))

    def _put(self, level: int, segment: tuple[int, int, str]) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(segment)
        if len(self.levels[level]) < FAN:
            return
        merged, self.levels[level] = self.levels[level], []
        whole = merged[0][0], merged[-1][1], "".join(text for *_, text in merged)
        write_whole(self._uri(*whole[:2]), whole[2])
        for uri in self.replaced.get(level, []):
            delete_file(uri)
        self.replaced[level] = [self._uri(*part[:2]) for part in merged]
        self._put(level + 1, whole)

    def event(self, table: str, state: str, **extras: object) -> None:
        """One state of one table; further facts go to ``extras``."""
        self.add(table=table, state=state, extras={k: str(v) for k, v in extras.items()})

    def validation(self, source: str, target: str, verdict: Mapping) -> None:
        self.add(source=source, target=target, validation=dict(verdict))


def append_journal(
    spark: SparkSession, path: str, run_id: str, table: str, state: str, **extras: object
) -> None:
    """Record one state of one table, in a file of its own."""
    EvidenceFile(spark, path, run_id).event(table, state, **extras)


def append_validation(
    spark: SparkSession, path: str, run_id: str, source: str, target: str, verdict: Mapping
) -> None:
    EvidenceFile(spark, path, run_id).validation(source, target, verdict)


def _union_of_segments(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All records below a path once each; a record may be in a segment and in the one it was merged into.

    Records without a number, of writers that know no segments, stay as they are.
    """
    read = spark.read.schema(f"{schema}, number bigint").option("mode", "FAILFAST").json(path)
    columns = [F.col(name) for name in read.columns if name != "number"]
    named = read.select(*columns, "number", F.substring_index("_metadata.file_name", ".", 1).alias("writer"))
    single = named.where("number IS NULL").select(*columns)
    several = named.where("number IS NOT NULL").groupBy("writer", "number")
    return single.unionByName(several.agg(F.any_value(F.struct(*columns)).alias("r")).select("r.*"))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """All journal events, the union of all segments. A malformed line is an error, found when the events are read."""
    return _union_of_segments(spark, path, JOURNAL_SCHEMA)


def read_validations(spark: SparkSession, path: str) -> DataFrame:
    return _union_of_segments(spark, path, VALIDATION_SCHEMA)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The journal lines that cannot be read, for repair."""
    schema = f"{JOURNAL_SCHEMA}, _corrupt_record string"
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    broken = spark.read.text(path).select(parsed["_corrupt_record"].alias("line"))
    return broken.where(F.col("line").isNotNull())


def latest_state(journal: DataFrame) -> DataFrame:
    """The last event per run and table by ``seq``, in run and table order.

    ``max_by`` keeps one event per group on the map side, however long a table's history is.
    """
    rest = [name for name in journal.columns if name not in ("run_id", "table")]
    last = F.max_by(F.struct(*rest), F.col("seq")).alias("last")
    return (
        journal.groupBy("run_id", "table")
        .agg(last)
        .select("run_id", "table", *[F.col(f"last.{name}").alias(name) for name in rest])
        .orderBy("run_id", "table")
    )

