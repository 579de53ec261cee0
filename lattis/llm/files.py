"""Files that tasks write in, and read from, the shared folder."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared URI (file, hdfs, s3, gs, ...) and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri[len("file:") :].replace("//", "", 1) if uri.startswith("file://") else uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """An output stream at ``uri``; its parent folders are made."""
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def size(uri: str) -> int:
    system, path = open_fs(uri)
    return system.get_file_info(path).size


def read_range(uri: str, offset: int, length: int) -> pa.Buffer:
    system, path = open_fs(uri)
    with system.open_input_file(path) as f:
        return f.read_buffer_at(length, offset) if hasattr(f, "read_buffer_at") else pa.py_buffer(f.read_at(length, offset))


def remove(uri: str) -> None:
    system, path = open_fs(uri)
    system.delete_file(path)


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name that no other attempt of any task has.

    A lost or speculative attempt leaves a file that no committed manifest
    names, so readers never see it.
    """
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"{prefix}-{t.partitionId():06d}-{t.taskAttemptId()}{suffix}"
