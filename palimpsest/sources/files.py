"""Files of the foreign formats: on the driver through Hadoop, in tasks through Arrow."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from palimpsest.functions.model import Conflict
from palimpsest.shared import file_system

BLOCK = 1 << 20
#: Schemes that tasks open themselves; others are read whole by Spark, and not written by tasks.
ARROW = ("", "file", "hdfs", "s3", "gs", "abfs", "abfss")


def scheme(path: str) -> str:
    return path.split("://", 1)[0] if "://" in path else path.split(":", 1)[0] if path.startswith("file:/") else ""


def _arrow(path: str) -> tuple[pafs.FileSystem, str]:
    if scheme(path) in ("", "file"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def opened(path: str) -> BinaryIO:
    """A file to read, in a task."""
    fs, at = _arrow(path)
    return fs.open_input_file(at)


@contextmanager
def created(folder: str, name: Callable[[], str]) -> Iterator[BinaryIO]:
    """A file to write, in a task: it gets its name when it is whole. Another attempt of the task
    writes beside it and replaces it by an equal one."""
    fs, at = _arrow(folder)
    fs.create_dir(at, recursive=True)
    beside = f"{at}/.{uuid.uuid4().hex}.tmp"
    try:
        with fs.open_output_stream(beside, buffer_size=BLOCK) as out:
            yield out
        fs.move(beside, f"{at}/{name()}")
    except BaseException:
        if fs.get_file_info(beside).type != pafs.FileType.NotFound:
            fs.delete_file(beside)
        raise


def writable_by_tasks(path: str) -> None:
    if scheme(path) not in ARROW:
        raise ValueError(f"tasks can't write to {scheme(path)}://; use one of {', '.join(filter(None, ARROW))}")


class Source:
    """A file as ranges of bytes, read in blocks."""

    def __init__(self, file: BinaryIO):
        self.file = file
        self.size = file.seek(0, 2)
        self.start, self.block = 0, b""

    def at(self, start: int, length: int) -> bytes:
        """The bytes of a range, fewer past the end."""
        if not self.start <= start <= start + length <= self.start + len(self.block):
            self.file.seek(start)
            self.start, self.block = start, self.file.read(max(length, BLOCK))
        return bytes(self.block[start - self.start : start - self.start + length])


def put_file(spark: SparkSession, path: str, data: bytes, sync: bool = False) -> None:
    """Creates a file that must not exist yet, all of it or nothing: it is written beside its place, with
    ``sync`` forced to disk, and renamed. :class:`Conflict` if another writer was first."""
    fs, target = file_system(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    beside = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(data))
        if sync:
            out.hsync()
    finally:
        out.close()
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(beside), fs.makeQualified(target), none)
    except Exception as error:
        fs.delete(beside, False)
        if "AlreadyExists" in str(error):
            raise Conflict(f"{path} exists: another writer was first") from error
        raise


def replace_file(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file anew: whoever reads it sees the old one or the new one."""
    fs, target = file_system(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    beside = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(data))
        out.hsync()
    finally:
        out.close()
    rename = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(beside), fs.makeQualified(target), over)
