"""Small helpers of the operators: shared scratch folders, and results cut from their lineage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import relayout
from relayout.session import scratch_folder

#: Rows that Spark hands to Python at a time; keeps long texts within a worker's memory.
ARROW_ROWS = 1000


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Make Python tasks work on any executor: ship this package, and hand over few rows at a time.

    Lazy plans read the batch setting when they run, so it stays set.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > ARROW_ROWS:
        spark.conf.set(setting, ARROW_ROWS)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(relayout.__file__))
        made = tempfile.mkdtemp(prefix="relayout-package-")  # on the driver, which serves it to executors
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = os.path.join(made, "relayout_package")
        context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(context.applicationId)


def folder(spark: SparkSession) -> str:
    """One shared scratch folder per session, named by spark.checkpoint.dir."""
    setting = "spark.relayout.llm.scratch"
    path = spark.conf.get(setting, None)
    if path is None:
        path = scratch_folder(spark)
        spark.conf.set(setting, path)
    return path


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(task: Task) -> Task:
    """The task, after which its worker gives freed memory back: idle workers stay beside stages that need none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


#: Scratch tables by the label under which they were made, and the label now in use, per thread.
_made: dict[tuple[str, str], list[str]] = {}
_now = threading.local()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df from a table in the shared folder: computed once, safe from lost executors."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:10]}"
    label = getattr(_now, "label", None)
    if label is not None:
        _made.setdefault((df.sparkSession.sparkContext.applicationId, label), []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(label: str) -> Iterator[None]:
    """Tables stored inside the block belong to the label, until ``release`` deletes them."""
    before, _now.label = getattr(_now, "label", None), label
    try:
        yield
    finally:
        _now.label = before


def release(spark: SparkSession, label: str) -> None:
    """Delete the scratch tables of a label, once nothing reads them any more."""
    context = spark.sparkContext
    for path in _made.pop((context.applicationId, label), []):
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
