"""Small files and folder listings in the store that the session's paths name, without Spark jobs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import suppress

from pyarrow import fs
from pyspark.sql import SparkSession

_SCHEME = re.compile(r"\A[A-Za-z][A-Za-z0-9+.-]*:")
# Scheme names of Spark's connectors that the file system library calls otherwise.
_SAME_STORE = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def default_filesystem(spark: SparkSession) -> str:
    """Where paths without a scheme live in this session, such as ``hdfs://ns1``."""
    return spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/")


def qualified(path: str, filesystem: str) -> str:
    """The path with its file system; ``filesystem`` is the default one."""
    if _SCHEME.match(path):
        return path
    scheme = filesystem.split(":", 1)[0]
    return (f"{scheme}://" if scheme == "file" else filesystem) + path


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, and the path within it."""
    scheme, rest = uri.split(":", 1)
    scheme = _SAME_STORE.get(scheme.lower(), scheme.lower())
    if scheme == "file":  # one slash or three: the same place
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{rest}")


def is_folder(uri: str) -> bool:
    """True if there is such a folder; a store that cannot be asked has none."""
    try:
        store, path = opened(uri)
        return store.get_file_info(path).type == fs.FileType.Directory
    except Exception:
        return False


def folder_entries(store: fs.FileSystem, path: str) -> tuple[list[str], int, int]:
    """Folders directly below a folder, and the bytes and number of its own files.

    All files count, empty and hidden ones too; only checksums that Spark's local file system keeps
    beside its files do not, being no files of the table.
    """
    local = isinstance(store, fs.LocalFileSystem)
    folders, size, files = [], 0, 0
    for entry in store.get_file_info(fs.FileSelector(path)):
        if entry.type == fs.FileType.Directory:
            folders.append(entry.path)
        elif not (local and entry.base_name.startswith(".") and entry.base_name.endswith(".crc")):
            size += entry.size or 0
            files += 1
    return folders, size, files


def files_below(store: fs.FileSystem, path: str) -> Iterator[tuple[str, int, int, bool]]:
    """Path, size, modification time in microseconds and whether it is hidden of every file at any depth."""
    local = isinstance(store, fs.LocalFileSystem)
    waiting = [(path, False)]
    while waiting:
        folder, hidden = waiting.pop()
        for entry in store.get_file_info(fs.FileSelector(folder)):
            unseen = hidden or entry.base_name[:1] in ("_", ".")
            if entry.type == fs.FileType.Directory:
                waiting.append((entry.path, unseen))
            elif not (local and entry.base_name.startswith(".") and entry.base_name.endswith(".crc")):
                yield entry.path, entry.size or 0, (entry.mtime_ns or 0) // 1000, unseen


def headed(uri: str, path: str, found: str) -> str:
    """A path that the store found, as the URI it was looked for: a store names its files without the scheme."""
    if uri.startswith("file:"):
        return f"file:{found}"
    return uri[: len(uri.rstrip("/")) - len(path.rstrip("/"))] + found


def delete_file(uri: str) -> None:
    """Delete a file, which may be gone already."""
    store, path = opened(uri)
    with suppress(FileNotFoundError):
        store.delete_file(path)


def write_whole(uri: str, text: str) -> None:
    """Write a small file so that readers see all of it or the one before."""
    store, path = opened(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    made = f"{folder}/_{uuid.uuid4().hex}"  # readers skip names that begin so
    with store.open_output_stream(made, compression=None) as out:
        out.write(text.encode())
    store.move(made, f"{folder}/{name}")
