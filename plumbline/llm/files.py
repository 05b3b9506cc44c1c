"""Files in the shared folder, written and read by tasks through Arrow's file systems (local, HDFS, object stores)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import DataFrame


def dealt(files: DataFrame) -> DataFrame:
    """Rows of ``files`` (path, ...) on as many tasks as there are rows. The number is stated: by their own bytes, which are few, Spark would merge all names into one task."""
    return files.repartitionByRange(max(1, files.count()), "path")


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str) -> Iterator[BinaryIO]:
    """A new file. Names are unique to a task attempt, and only names that a successful task reports are read: what a lost
    attempt leaves behind is ignored."""
    system, path = locate(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        yield out


@contextmanager
def reading(uri: str, random: bool = False) -> Iterator[BinaryIO]:
    system, path = locate(uri)
    with (system.open_input_file(path) if random else system.open_input_stream(path, compression=None, buffer_size=1 << 20)) as f:
        yield f


def remove(uri: str) -> None:
    system, path = locate(uri)
    system.delete_file(path)
