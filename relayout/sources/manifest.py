"""File manifests: every file of some tables, listed by a data source whose read tasks are partition locations.

The catalogue says where each partition is, so files that nothing refers to any more (those that compaction replaced,
unregistered folders) are not in a manifest, and partitions stored elsewhere are. No row of a table is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from relayout.functions.canonical import column
from relayout.session import scratch_folder, ship
from relayout.sources.catalog import NO_VALUE, describe_table, partition_places
from relayout.sources.files import NOT_FOUND, normalized_location
from relayout.sources.store import default_filesystem, files_below, headed, opened, qualified, write_whole

_SCHEMA = (
    "table_name string, partition string, location string, path string, bytes bigint, modified bigint, "
    "hidden boolean, error string"
)
# Read tasks of one listing; beyond it a task lists several locations.
_TASKS = 2000
_ROWS = 10_000


@dataclass
class Places(InputPartition):
    """Locations of one read task: table, partition, location."""

    places: list[tuple[str, str, str]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.request = options["request"]

    def partitions(self) -> Sequence[Places]:
        store, path = opened(self.request)
        with store.open_input_stream(path, compression=None) as lines:
            places = [tuple(json.loads(line)) for line in lines.read().decode().splitlines()]
        each = max(1, -(-len(places) // _TASKS))
        return [Places(places[at : at + each]) for at in range(0, len(places), each)] or [Places([])]

    def read(self, partition: Places) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.bool_(), pa.string()]
        names = [field.split(" ")[0] for field in _SCHEMA.split(", ")]
        rows: list[tuple] = []
        for table, part, location in partition.places:
            try:
                store, path = opened(location)
                for found, size, modified, hidden in files_below(store, path):
                    rows.append((table, part, location, headed(location, path, found), size, modified, hidden, None))
                    if len(rows) >= _ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
            except FileNotFoundError:
                rows.append((table, part, location, None, None, None, None, f"{NOT_FOUND}{location}"))
            except Exception as failure:
                text = str(failure) or type(failure).__name__
                rows.append((table, part, location, None, None, None, None, text))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class FileManifest(DataSource):
    """``request``: a file of JSON lines [table, partition, location], so that plans do not grow with partitions."""

    @classmethod
    def name(cls) -> str:
        return "relayout_manifest"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)


def list_files(spark: SparkSession, places: Sequence[tuple[str, str, str]]) -> DataFrame:
    """table_name, partition, location, path, bytes, modified (microseconds), hidden, error of every file below places.

    A location that cannot be listed is one row with an error. Files whose name or folder below the location starts
    with a dot or an underscore are hidden: table scans do not read them.
    """
    ship(spark)
    filesystem = default_filesystem(spark)
    request = f"{qualified(scratch_folder(spark), filesystem)}/manifest.json"
    lines = [json.dumps([table, part, qualified(place, filesystem)]) for table, part, place in places]
    write_whole(request, "\n".join(lines))
    spark.dataSource.register(FileManifest)
    return spark.read.format(FileManifest.name()).option("request", request).load()


def table_files(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """``list_files`` of whole tables; ``partition`` is as SHOW PARTITIONS prints it, blank without partitions."""
    places: list[tuple[str, str, str]] = []
    for table in tables:
        described = describe_table(spark, table)
        if described["partitions"]:
            places += [(table, shown, place) for shown, place in partition_places(spark, table)]
        else:
            places.append((table, "", described["location"]))
    return list_files(spark, places)


def data_files(files: DataFrame) -> DataFrame:
    """The files that a scan reads, none where a location does not exist; fails where one could not be listed."""
    failed = F.raise_error(F.concat(F.lit("not listed: "), "location", F.lit(": "), "error")).cast("boolean")
    unknown = F.col("error").isNotNull() & ~F.startswith("error", F.lit(NOT_FOUND))
    return files.where(F.when(unknown, failed).otherwise(F.coalesce(F.expr("NOT hidden AND bytes > 0"), F.lit(False))))


def relative_path() -> Column:
    """The file's path below its partition's location, behind the partition: the same wherever a table is moved."""
    place = F.length(normalized_location(F.col("location")))
    below = F.substr(normalized_location(F.col("path")), place + 2)
    return F.concat_ws("/", F.nullif("partition", F.lit("")), below)


def partition_value(name: str, kind: str) -> Column:
    """The value of a partition column from ``partition``, in the column's type."""
    escaped = F.regexp_extract("partition", rf"(?:^|/)\Q{_escaped(name)}\E=([^/]*)", 1)
    value = F.url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B")))
    return F.when(escaped != NO_VALUE, value.cast(kind)).alias(name)


def _escaped(name: str) -> str:
    """A column's name in folder names; names are plain or stay as they are but for these."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\\x7f{[]^" or ord(c) < 32 else c for c in name)


def files_by_partition(spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
    """Bytes and number of data files in each partition, by its values; one row without partitions."""
    files = data_files(table_files(spark, [table]))
    per = files.groupBy("partition").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
    types = {field.name: field.dataType.simpleString() for field in spark.table(table).schema}
    values = [partition_value(key, types[key]) for key in keys]
    return per.select(*values, "bytes", "files", *([column("partition")] if "partition" not in keys else []))
