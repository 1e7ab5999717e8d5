"""Fingerprints that are kept by file, so that a table validated again is not read again.

Hash sums add up, so the fingerprint of a table is the sum over its files. Those of a file are stored under its place in
its table, its size and its time of change; a later validation lists the files, hashes those that are new or changed,
and takes the rest from the store. A table that was renamed keeps its files' places, sizes and times. Files changed within
the resolution of their time, without a change of size, are not noticed: the first validation of a run reads them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relayout.functions.canonical import column
from relayout.functions.fingerprint import MEASURES, fingerprint
from relayout.sources.catalog import describe_table
from relayout.sources.files import kept, normalized_location
from relayout.sources.manifest import data_files, relative_path, table_files
from relayout.sources.store import default_filesystem, is_folder, qualified

# Fixed value: formats whose scans tell the file of a row.
FILE_FORMATS = ("parquet", "orc", "csv", "json", "text", "avro")
# Changed files that a scan is told one by one; of more, it is told the partitions.
_NAMED_FILES = 1000
_FILE = ("file", "bytes", "modified")


def knowable(spark: SparkSession, table: str) -> bool:
    """True if the rows of a table can be told apart by file; padding of CHAR columns hides the files."""
    described = describe_table(spark, table)
    padded = any("char(" in kind.lower() for _, kind in described["columns"])
    return described["provider"].lower() in FILE_FORMATS and bool(described["location"]) and not padded


def current_files(spark: SparkSession, table: str) -> DataFrame:
    """file (its place in the table), bytes, modified and path of every data file, as they are now."""
    files = data_files(table_files(spark, [table]))
    return kept(files.select(relative_path().alias("file"), "bytes", "modified", normalized_location(F.col("path")).alias("path")))


def digest(files: DataFrame) -> tuple:
    """One value of a set of files: equal where no file was added, removed or changed."""
    code = F.xxhash64(*_FILE)
    return tuple(files.agg(F.count(F.lit(1)), F.sum("bytes"), F.sum(code % (1 << 40)), F.bit_xor(code)).first())


@dataclass
class Store:
    """Fingerprints by file below a folder. ``hashed`` counts the files that were read."""

    spark: SparkSession
    folder: str
    hashed: int = 0

    def _path(self, df: DataFrame, keys: Sequence[str], as_text: Collection[int]) -> str:
        shape = json.dumps([df.schema.jsonValue(), list(keys), sorted(as_text)], sort_keys=True)
        return f"{self.folder.rstrip('/')}/{hashlib.sha256(shape.encode()).hexdigest()[:32]}"

    def _read(self, path: str, schema: object) -> DataFrame:
        if not is_folder(qualified(path, default_filesystem(self.spark))):  # nothing stored yet
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def fingerprints(
        self, table: str, df: DataFrame, keys: Sequence[str] = (), as_text: Collection[int] = ()
    ) -> DataFrame:
        """``fingerprint(df, keys, as_text)``, where df has columns of the table; only files not known are read."""
        spark, path = self.spark, self._path(df, keys, as_text)
        names = [f"k{i}" for i in range(len(keys))]
        files = current_files(spark, table)
        rows = spark.table(table).select(*map(column, df.columns), F.col("_metadata.file_path").alias("__file"))
        schema = files.select(*_FILE).join(_by_file(rows, keys, as_text).drop("path")).schema
        known = self._read(path, schema)
        new = kept(files.join(known.select(*_FILE).distinct(), list(_FILE), "left_anti"))
        count = new.count()
        if count:
            self.hashed += count
            if count == files.count():  # the whole table: no row has to be asked for its file's name
                pass
            elif count <= _NAMED_FILES:
                wanted = [row["path"] for row in new.select("path").collect()]
                rows = rows.where(_plain_path("__file").isin(wanted))
            else:
                rows = rows.join(new.select("path"), _plain_path("__file") == F.col("path"), "left_semi")
            made = _by_file(rows, keys, as_text)
            # a file without rows is known too; one that changed while it was read is not
            found = new.join(made, "path", "left").join(current_files(spark, table).select(*_FILE), list(_FILE), "left_semi")
            found.select(*[F.col(field.name).cast(field.dataType) for field in schema]).na.fill(0, ["row_count"]).write.mode("append").parquet(path)
            known = self._read(path, schema)
        mine = known.dropDuplicates([*_FILE, *names]).join(files.select(*_FILE), list(_FILE), "left_semi")
        grouped = mine.where("row_count > 0").groupBy(*names)
        total = F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count")
        # kept: two readings of one folder at different times look alike to the planner, which would share them
        return kept(grouped.agg(total, *_hash_sums())).toDF(*keys, *MEASURES)


def _hash_sums() -> list[Column]:
    return [F.sum(name).cast("decimal(38,0)").alias(name) for name in MEASURES[1:]]


def _by_file(rows: DataFrame, keys: Sequence[str], as_text: Collection[int]) -> DataFrame:
    """Fingerprints by the keys, called k0, k1, …, and ``path``; the last column is the scan's name of a row's file.

    Rows are grouped by that name as it is: it is brought to the manifest's spelling once a group, not once a row.
    """
    names = [f"k{i}" for i in range(len(keys))]
    named = fingerprint(rows, [*keys, "__file"], as_text, unhashed=1).toDF(*names, "__file", *MEASURES)
    grouped = named.groupBy(*names, _plain_path("__file").alias("path"))
    return grouped.agg(F.sum("row_count").alias("row_count"), *_hash_sums())


def _plain_path(name: str) -> Column:
    """The scan's name of a file in the manifest's spelling."""
    return normalized_location(F.url_decode(F.replace(F.col(name), F.lit("+"), F.lit("%2B"))))
