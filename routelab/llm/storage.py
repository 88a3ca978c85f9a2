"""Files in the shared folder, written and range-read by executors through pyarrow's file systems (local, hdfs, s3, gs, abfs)."""

from __future__ import annotations

import posixpath

from pyarrow import fs
from pyspark.sql import SparkSession


def tasks_for(spark: SparkSession, size: int, task_bytes: int = 1 << 23) -> int:
    """Tasks for reading so many bytes: at least two for each core, else one for each ``task_bytes``."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-size // task_bytes))


def write_bytes(uri: str, parts: list[bytes]) -> int:
    """Write a new file; returns its size. Names hold an attempt's own token, so a repeated task never meets another's file."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    with system.open_output_stream(path) as out:
        for part in parts:
            out.write(part)
    return sum(map(len, parts))


class RangeFile:
    """Random access to a file: only the ranges asked for are read."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def __enter__(self) -> RangeFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


class Appender:
    """A new file written piece by piece."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(posixpath.dirname(path), recursive=True)
        self.out = system.open_output_stream(path)

    def write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)

    def close(self) -> None:
        self.out.close()
