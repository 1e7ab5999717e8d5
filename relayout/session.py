"""Session helpers: scoped SQL settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def sql_settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Apply SQL settings for the actions run inside the block, then restore them."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, for the functions that run in their Python workers."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    made = tempfile.mkdtemp(prefix="relayout-package-")  # on the driver, which serves it
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    base = os.path.join(made, "relayout_package")
    context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
    _shipped.add(context.applicationId)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared one the cluster names; a local one only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/relayout-{uuid.uuid4().hex[:12]}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix="relayout-")
