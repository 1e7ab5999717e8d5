"""Table rewrites: casts, partition layout and file sizes, as ordinary DataFrame writes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from relayout.functions.canonical import column
from relayout.functions.fingerprint import observed
from relayout.functions.layout import layout_columns
from relayout.functions.naming import COMPACTED_SUFFIX, quoted_table
from relayout.operators.compare import retyped_positions
from relayout.session import sql_settings
from relayout.sources.catalog import describe_table, table_exists
from relayout.sources.files import TARGET_FILE_BYTES

# Fixed value: the compression of new files.
COMPRESSION = "zstd"
# Formats whose files compaction can pack.
FILE_FORMATS = ("parquet", "orc")

# A task of a partitioned write holds this many files open and streams its rows into them, where sorting them by
# partition first would take several times the memory of the file; rows of any further partition are sorted.
OPEN_FILES = {"spark.sql.optimizer.plannedWrite.enabled": "false", "spark.sql.maxConcurrentOutputFileWriters": "8"}

# A reader task takes at most target / _OPEN_COST_BYTES files.
_OPEN_COST_BYTES = 64 * 1024
# Partitions compacted in one job; bounds the size of its plan.
_SCANS_PER_JOB = 64


def cast_projection(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """Every column in its place, the listed ones cast."""
    unknown = sorted(set(casts) - set(df.columns))
    if unknown:
        raise ValueError(f"columns to cast that the table lacks: {unknown}")
    return df.select(
        *[
            column(name).cast(casts[name]).alias(name) if name in casts else column(name)
            for name in df.columns
        ]
    )


def with_layout(df: DataFrame, spec: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """The table with its derived partition columns, all partition columns, and the derived ones."""
    names, derived = layout_columns(list(spec), df.schema)
    return (df.withColumns(derived) if derived else df), names, list(derived)


def clustered(
    df: DataFrame, keys: Sequence[str], size_bytes: int = 0, target_file_bytes: int = TARGET_FILE_BYTES
) -> DataFrame:
    """Bring rows of a partition together before a partitioned write; no shuffle without keys.

    The rebalance lets the adaptive planner cut a hot partition value into several tasks by
    shuffle blocks, so one value holding a third of the table does not become one task, and rows
    are never salted by a random number that a retried task would draw again.
    """
    if not keys:
        return df
    wanted = math.ceil(size_bytes / target_file_bytes)
    return df.hint("rebalance", *([wanted] if wanted > 1 else []), *map(column, keys))


def keeps_partitions(keys: Sequence[str], derived: Sequence[str], stored_by: Sequence[str]) -> bool:
    """True if each file of the source already lies within one partition of the target."""
    return not derived and {k.lower() for k in keys} <= {name.lower() for name in stored_by}


def _write_settings(target_file_bytes: int) -> dict[str, str]:
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_file_bytes),
        "spark.sql.parquet.compression.codec": COMPRESSION,
        "spark.sql.orc.compression.codec": COMPRESSION,
        "hive.exec.dynamic.partition.mode": "nonstrict",
        **OPEN_FILES,
    }


def _packing_settings(size_bytes: int, target_file_bytes: int) -> dict[str, str]:
    """Make each reader task cover one output file, so compaction needs no shuffle."""
    return {
        "spark.sql.files.maxPartitionBytes": str(target_file_bytes),
        "spark.sql.files.openCostInBytes": str(min(_OPEN_COST_BYTES, target_file_bytes)),
        "spark.sql.files.minPartitionNum": str(max(1, math.ceil(size_bytes / target_file_bytes))),
    }


def rewrite_table(
    spark: SparkSession,
    source: str,
    target: str,
    spec: Sequence[str] = (),
    casts: Mapping[str, str] | None = None,
    location: str = "",
    fmt: str = "parquet",
    size_bytes: int = 0,
    target_file_bytes: int = TARGET_FILE_BYTES,
    small_files: bool = True,
    observation: Observation | None = None,
) -> list[str]:
    """Copy ``source`` into the new table ``target``; returns the derived partition columns.

    ``observation`` gets the fingerprint of the rows as they are read for the copy, without a scan of its own.

    Refuses to overwrite. ``size_bytes``, where known, sets how finely partitions are shuffled. A
    source that is stored by the target's partitions, in files that are not small, is copied
    without a shuffle. So is any source without partitions in the target: there, each task packs
    small files up to one of the target size.
    """
    if table_exists(spark, target):
        raise RuntimeError(f"{target} exists already and is not overwritten")
    read = spark.table(source)
    projected = cast_projection(read, casts or {})
    if observation is not None:
        as_text = retyped_positions(read.schema, projected.schema)
        projected = cast_projection(observed(read, observation, as_text), casts or {})
    laid_out, keys, derived = with_layout(projected, spec)
    settings = _write_settings(target_file_bytes)
    stored_by = describe_table(spark, source)["partitions"]
    if keys and (small_files or not keeps_partitions(keys, derived, stored_by)):
        laid_out = clustered(laid_out, keys, size_bytes, target_file_bytes)
    else:
        settings |= _packing_settings(size_bytes, target_file_bytes)
    writer = laid_out.write.mode("errorifexists").format(fmt).option("compression", COMPRESSION)
    if keys:
        writer = writer.partitionBy(*keys)
    if location:
        writer = writer.option("path", location)
    with sql_settings(spark, settings):
        writer.saveAsTable(target)
    return derived


def scattered(files: DataFrame, target_file_bytes: int) -> DataFrame:
    """The partitions that files of the target size would hold in at most half as many."""
    needed = F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(target_file_bytes)))
    return files.where(F.col("files") >= 2 * needed)


def packable(spark: SparkSession, table: str) -> dict:
    """The table's description, if its files can be packed."""
    described = describe_table(spark, table)
    if described["provider"].lower() not in FILE_FORMATS:
        raise ValueError(f"{table} is stored as {described['provider']}: only {', '.join(FILE_FORMATS)} are compacted")
    if described["num_buckets"] not in ("", "0", "None"):
        raise ValueError(f"{table} is bucketed: packing its files would break the buckets")
    return described


def pack_partitions(
    spark: SparkSession, table: str, parts: Sequence[Row], folder: str, target_file_bytes: int, jobs: int = 4
) -> None:
    """Write the rows of some partitions into files of the target size below a new folder.

    Other partitions are not read. Each task packs files of one partition into a new one, so nothing is
    shuffled and a hot partition is just more tasks. Jobs of some partitions each run side by side.
    """
    described = packable(spark, table)
    keys = described["partitions"]

    def write(batch: DataFrame) -> None:
        writer = batch.write.mode("append").format(described["provider"]).option("compression", COMPRESSION)
        writer.partitionBy(*keys).save(folder)

    settings = _write_settings(target_file_bytes) | _packing_settings(0, target_file_bytes)
    with sql_settings(spark, settings), ThreadPoolExecutor(jobs) as pool:
        list(pool.map(write, partition_batches(spark.table(table), keys, parts)))


def packed_copy(spark: SparkSession, table: str, copy: str, size: int, target_file_bytes: int) -> None:
    """Fill a new table like ``table``, which has no partitions, with its rows in files of the target size.

    The copy keeps declared types; an external table's copy lies beside it.
    """
    described = packable(spark, table)
    beside = ""
    if "EXTERNAL" in described["type_raw"].upper():
        place = f"{described['location'].rstrip('/')}{COMPACTED_SUFFIX}/{copy}".replace("'", "\\'")
        beside = f" LOCATION '{place}'"
    spark.sql(f"CREATE TABLE {quoted_table(copy)} LIKE {quoted_table(table)}{beside}")
    settings = _write_settings(target_file_bytes) | _packing_settings(size, target_file_bytes)
    with sql_settings(spark, settings):
        spark.table(table).write.insertInto(copy)


def partition_batches(
    df: DataFrame, keys: Sequence[str], parts: Sequence[Row], batch: int = _SCANS_PER_JOB
) -> Iterator[DataFrame]:
    """Some partitions of a table as unions of one pruned scan each, a number of them at a time.

    Scans pack files by size only; with a scan of its own, no partition shares a task with another.
    """
    for start in range(0, len(parts), batch):
        yield _union([df.where(in_partition(row)) for row in parts[start : start + batch]])


def _union(frames: list[DataFrame]) -> DataFrame:
    """Joined by halves: one by one, each union would be analysed again with all before it."""
    if len(frames) == 1:
        return frames[0]
    middle = len(frames) // 2
    return _union(frames[:middle]).union(_union(frames[middle:]))


def in_partition(row: Row) -> Column:
    tests = [
        column(name).isNull() if value is None else column(name) == value
        for name, value in row.asDict().items()
    ]
    return reduce(Column.__and__, tests)


def rows_out_of_sight(spark: SparkSession, table: str, fmt: str) -> bool:
    """True if the table's directory holds rows; asked where the table itself shows none.

    A partitioned table whose partitions are not registered reads as empty and would compare equal
    to another such table.
    """
    location = describe_table(spark, table)["location"]
    try:
        stored = spark.read.format(fmt).option("recursiveFileLookup", True).load(location)
    except AnalysisException:
        return False  # no data files at all
    return not stored.isEmpty()
