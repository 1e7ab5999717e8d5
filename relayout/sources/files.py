"""File sizes per table: executors list folders; the driver holds one row per table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from relayout.functions.naming import COMPACTED_SUFFIX
from relayout.session import scratch_folder, ship
from relayout.sources.catalog import partition_places
from relayout.sources.store import default_filesystem, folder_entries, headed, is_folder, opened, qualified

# Average file size in MiB below which a table should be compacted, size of the files that a rewrite or a
# compaction aims at, and the text for a table without a location.
SMALL_FILE_MB = 64
TARGET_FILE_BYTES = 512 * 1024 * 1024
NO_LOCATION = "Hive metastore did not return a table location"
NOT_FOUND = "location not found: "

_FOLDERS = "location string, directory string, bytes bigint, files bigint, error string"
# Entries that a task looks at in the first job, folders that wait for each task of the next, and tasks at most.
_FIRST_ENTRIES = 1000
_TASK_FOLDERS = 32
_TASKS = 2000


def outermost(locations: Sequence[str]) -> list[str]:
    """The locations that lie below none of the others, one spelling each."""
    named = {re.sub(r"\Afile:/+", "file:/", name.rstrip("/")): name for name in sorted(locations)}

    def below_another(name: str) -> bool:
        parts = name.split("/")
        return any("/".join(parts[:depth]) in named for depth in range(1, len(parts)))

    return [name for name in named if not below_another(name)]


def list_folders(spark: SparkSession, locations: Sequence[str]) -> DataFrame:
    """Every folder at or below the locations with the bytes and number of its own files.

    Executors list, the driver holds the given locations only. A folder is listed once however many
    locations it lies below: give ``outermost`` ones. Trees may have any shape: a task stops after a number of entries and
    leaves the folders that it has not come to yet to the next job, which deals them out again; what a task may look at
    doubles from job to job, so their number grows with the logarithm of a tree's size. A location that cannot
    be listed is a row with an error.
    """
    filesystem = default_filesystem(spark)
    roots = [(name, qualified(name, filesystem)) for name in locations]
    waiting = spark.createDataFrame(roots, "location string, directory string")
    number, entries, done = len(roots), _FIRST_ENTRIES, []
    while number:
        found = kept(_spread(waiting, number).mapInArrow(_listing(entries), f"{_FOLDERS}, waiting boolean"))
        done.append(found.where("NOT waiting").drop("waiting"))
        waiting = found.where("waiting").select("location", "directory")
        number, entries = waiting.count(), 2 * entries
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], _FOLDERS)


def _spread(folders: DataFrame, number: int) -> DataFrame:
    """Folders dealt to tasks by their number; left to itself, the planner would go by the few bytes of their names."""
    return folders.repartition(min(_TASKS, -(-number // _TASK_FOLDERS)), F.col("directory"))


def kept(found: DataFrame) -> DataFrame:
    """The rows from a table of their own in the shared folder, computed once."""
    spark = found.sparkSession
    path = f"{scratch_folder(spark)}/folders"
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def _listing(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """List folders and what lies below them until ``most`` entries are seen; the rest waits. Errors become rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        names = ["location", "directory", "bytes", "files", "error", "waiting"]
        rows: list[tuple] = []
        queue = [pair for batch in batches for pair in zip(*(batch.column(n).to_pylist() for n in names[:2]))]
        seen = 0
        while queue:
            location, directory = queue.pop()
            if seen >= most:
                rows.append((location, directory, None, None, None, True))
            else:
                try:
                    store, path = opened(directory)
                    below, size, files = folder_entries(store, path)
                    queue += [(location, headed(directory, path, folder)) for folder in below]
                    seen += 1 + len(below) + files
                    rows.append((location, headed(directory, path, path), size, files, None, False))
                except FileNotFoundError:
                    rows.append((location, directory, None, None, f"{NOT_FOUND}{directory}", False))
                except Exception as failure:
                    rows.append((location, directory, None, None, str(failure) or type(failure).__name__, False))
            if len(rows) >= 10_000:
                yield _record(rows, kinds, names)
                rows = []
        if rows:
            yield _record(rows, kinds, names)

    return run


def _record(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def measure_locations(spark: SparkSession, tables: DataFrame) -> DataFrame:
    """``location_facts`` of real directories, one row per ``(table_name, location)``.

    The result has one row per table like the catalogue itself, and is computed here.
    """
    ship(spark)
    located = tables.where("location <> ''").select("location").distinct()
    locations = [row["location"] for row in located.collect()]
    filesystem = default_filesystem(spark)
    plain = outermost([qualified(name, filesystem) for name in locations])
    if not plain:
        plain_folders = spark.createDataFrame([], _FOLDERS)
    else:
        plain_folders = kept(list_folders(spark, plain))
    sizes = folder_totals(plain_folders.where("error IS NULL").select("directory", "bytes", "files"))
    failed = plain_folders.where("error IS NOT NULL").select(
        normalized_location(F.col("directory")).alias("failed"), "error"
    )
    facts = _facts_of(tables, sizes, failed, filesystem)
    return spark.createDataFrame(facts.collect(), facts.schema)


def measure_tables(spark: SparkSession, tables: DataFrame) -> DataFrame:
    """``measure_locations`` of whole tables, where the catalogue says that they are.

    ``places`` is the number of these locations. ``tables`` has ``table_name``, ``location`` and ``partitions``. The files of a partitioned table are those at its
    partitions' locations, wherever these lie; other files below its folder or the one beside it that compaction
    writes to are ``replaced_files`` with ``replaced_bytes``: old versions, and folders that are not registered.
    """
    rows = tables.select("table_name", "location", "partitions").collect()
    split = [row["table_name"] for row in rows if row["partitions"] and row["location"]]
    places: list[tuple[str, str, str]] = []
    for row in rows:
        if row["table_name"] in split:
            beside = f"{row['location'].rstrip('/')}{COMPACTED_SUFFIX}"
            places.append((row["table_name"], "folder", row["location"]))
            if is_folder(qualified(beside, default_filesystem(spark))):
                places.append((row["table_name"], "beside", beside))
            named = partition_places(spark, row["table_name"])
            places += [(row["table_name"], "partition", place) for _, place in named]
        else:
            places.append((row["table_name"], "whole", row["location"]))
    listed = spark.createDataFrame([(str(i), place) for i, (_, _, place) in enumerate(places)], "table_name string, location string")
    measured = {int(row["table_name"]): row for row in measure_locations(spark, listed).collect()}
    found = {row["table_name"]: _Sum(row["location"]) for row in rows}
    for i, (name, role, _) in enumerate(places):
        found[name].add(role, measured[i])
    out = spark.createDataFrame([(name, *one.facts()) for name, one in found.items()], _TABLE_FACTS)
    return out.withColumn("average_file_mb", F.round(_mean_mib(), 2))


_TABLE_FACTS = (
    "table_name string, location string, bytes bigint, files bigint, error string, places bigint, "
    "replaced_bytes bigint, replaced_files bigint"
)


class _Sum:
    """Sizes of one table's locations. Its folder and the one beside it hold partitions and what is left over."""

    def __init__(self, location: str):
        self.location = location
        self.own, self.heads, self.inner, self.places = [0, 0], [0, 0], [0, 0], 0
        self.split, self.found, self.error, self.folder_error = False, False, None, None
        self.folders: list[str] = []

    def add(self, role: str, facts: Row) -> None:
        sizes = [facts["bytes"] or 0, facts["files"] or 0]
        if role in ("folder", "beside"):
            self.split = True
            self.folder_error = self.folder_error or (facts["error"] if role == "folder" else None)
            self.folders.append(_plain(facts["location"]))
            self.heads = [a + b for a, b in zip(self.heads, sizes)]
            return
        self.places += 1
        self.own = [a + b for a, b in zip(self.own, sizes)]
        if any(_plain(facts["location"]).startswith(f"{folder}/") for folder in self.folders):
            self.inner = [a + b for a, b in zip(self.inner, sizes)]
        # a registered partition needs no folder as long as it is empty
        if facts["error"] is None:
            self.found = True
        elif not (role == "partition" and facts["error"].startswith(NOT_FOUND)):
            self.error = min(self.error or facts["error"], facts["error"])

    def facts(self) -> tuple:
        # a partitioned table without partitions holds nothing, if its folder is there
        error = self.error or (None if self.found else self.folder_error)
        sizes = [None, None] if error else self.own
        rest = [max(a - b, 0) for a, b in zip(self.heads, self.inner)] if self.split else [None, None]
        return self.location, *sizes, error, self.places if self.split else None, *rest


def _plain(location: str) -> str:
    return re.sub(r"\Afile:/+", "file:/", location.rstrip("/"))


def _facts_of(tables: DataFrame, sizes: DataFrame, failed: DataFrame, filesystem: str) -> DataFrame:
    """Facts from folder totals; a folder that failed fails every location at, above or below it."""
    full = F.when(
        F.col("location").startswith("/"),
        F.concat(F.lit("file:" if filesystem.startswith("file:") else filesystem), "location"),
    ).otherwise(F.col("location"))
    named = tables.select("table_name", "location", normalized_location(full).alias("directory"))
    steps = F.split("failed", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)),
                                  lambda depth: F.array_join(F.slice(steps, 1, depth), "/")))
    errors = failed.select(above.alias("directory"), "error").groupBy("directory").agg(F.min("error").alias("message"))
    joined = named.join(sizes, "directory", "left").join(errors, "directory", "left")
    blank = F.coalesce("location", F.lit("")) == ""
    missing = F.when(F.col("files").isNull(), F.concat(F.lit(NOT_FOUND), F.col("location")))
    error = F.when(blank, NO_LOCATION).otherwise(F.coalesce("message", missing))
    found = error.isNull()
    return joined.select(
        "table_name", "location", F.when(found, F.col("bytes")).cast("bigint").alias("bytes"),
        F.when(found, F.col("files")).cast("bigint").alias("files"), error.alias("error"),
    ).withColumn("average_file_mb", F.round(_mean_mib(), 2))


def normalized_location(location: Column) -> Column:
    """One spelling per directory: no trailing slash, one slash after ``file:``."""
    trimmed = F.regexp_replace(location, r"/+\z", "")
    return F.regexp_replace(trimmed, r"\Afile:/+", "file:/")


def directory_totals(files: DataFrame) -> DataFrame:
    """Bytes and files below every directory, at any depth.

    Files are summed per parent first; only directory totals are repeated per ancestor, and the
    ancestors near the root, which every directory shares, are summed before the shuffle.
    """
    path = normalized_location(F.col("path"))
    parents = (
        files.select(F.regexp_replace(path, r"/[^/]*\z", "").alias("parent"), "length")
        .groupBy("parent")
        .agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))
    )
    return folder_totals(parents.withColumnRenamed("parent", "directory"))


def folder_totals(folders: DataFrame) -> DataFrame:
    """Bytes and files below every directory, from those of each folder itself."""
    folders = folders.withColumn("parent", normalized_location(F.col("directory"))).drop("directory")
    steps = F.split("parent", "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda depth: F.array_join(F.slice(steps, 1, depth), "/"),
    )
    return (
        folders.select(F.explode(ancestors).alias("directory"), "bytes", "files")
        .groupBy("directory")
        .agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))
    )


def location_facts(
    tables: DataFrame, files: DataFrame, errors: DataFrame | None = None, filesystem: str = ""
) -> DataFrame:
    """Bytes, files and average size for each ``(table_name, location)``, or an ``error`` text.

    Tables that share a directory each get its full size. ``errors`` is ``(location, message)``; without
    it a directory in which no file was found counts as not found. ``filesystem`` is where
    locations that start with a slash live.
    """
    full = F.when(
        F.col("location").startswith("/"), F.concat(F.lit(filesystem), "location")
    ).otherwise(F.col("location"))
    named = tables.select("table_name", "location", normalized_location(full).alias("directory"))
    blank = F.coalesce("location", F.lit("")) == ""
    joined = named.join(directory_totals(files), "directory", "left")
    if errors is None:
        failure = F.when(
            F.col("files").isNull(), F.concat(F.lit(NOT_FOUND), F.col("location"))
        )
    else:
        joined = joined.join(errors, "location", "left")
        failure = F.col("message")
    error = F.when(blank, NO_LOCATION).otherwise(failure)
    found = error.isNull()
    return joined.select(
        "table_name",
        "location",
        F.when(found, F.coalesce("bytes", F.lit(0))).cast("bigint").alias("bytes"),
        F.when(found, F.coalesce("files", F.lit(0))).cast("bigint").alias("files"),
        error.alias("error"),
    ).withColumn("average_file_mb", F.round(_mean_mib(), 2))


def _mean_mib() -> Column:
    mib = F.lit(1024.0 * 1024.0).cast("double")
    return F.col("bytes").cast("double") / F.greatest("files", F.lit(1)) / mib


def size_columns(places: bool = False) -> dict[str, Column]:
    """Plan sizes from ``bytes`` and ``files``; ``compact`` judges the rounded average.

    With ``places``, the number of a table's partitions, which need a file each, a partitioned table is not marked where
    packing could not even halve its files: one that was compacted is done, however small it is.
    """
    average = F.round(_mean_mib(), 1)
    gib = F.lit(1024.0 * 1024.0 * 1024.0).cast("double")
    small = average < SMALL_FILE_MB
    if places:
        needed = F.greatest("places", F.ceil(F.col("bytes") / F.lit(TARGET_FILE_BYTES)))
        small &= F.col("places").isNull() | (F.col("files") > 2 * needed)
    return {
        "size_gb": F.round(F.col("bytes").cast("double") / gib, 2),
        "avg_file_mb": average,
        "compact": F.when(small, "Y").when(average.isNotNull(), "N"),
    }


def table_sizes(facts: DataFrame) -> DataFrame:
    return facts.withColumns(size_columns("places" in facts.columns))
