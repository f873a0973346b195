"""The framed log format: encoding, decoding, a Spark data source and a writer.

A record is ``length u32 | crc32 u32 | body``, the length counting checksum and
body; a body is ``seq u64 | op u8 | key length u32 | key`` and, for a put (op 0),
``value length u32 | value``. All little-endian. A file that ends within a record
was cut off while written: what came before counts. Anything else that doesn't
fit is corruption.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import batched, chain
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from palimpsest.functions.model import MAX_LOG_RECORD_BYTES, Corrupt
from palimpsest.functions.scalar import log_frame
from palimpsest.shipping import ship
from palimpsest.sources.files import ARROW, created, opened, scheme, writable_by_tasks

Record = tuple[int, bytes, bytes | None]
_HEAD = struct.Struct("<QBI")


def encode_record(seq: int, key: bytes, value: bytes | None) -> bytes:
    body = _HEAD.pack(seq, value is None, len(key)) + key
    if value is not None:
        body += struct.pack("<I", len(value)) + value
    if len(body) + 4 > MAX_LOG_RECORD_BYTES:
        raise ValueError("record is longer than a reader would accept")
    return struct.pack("<II", len(body) + 4, zlib.crc32(body)) + body


def decode(data: bytes | BinaryIO) -> Iterator[Record]:
    """The records of a file, read one by one; stops at a cut-off tail, raises :class:`Corrupt` otherwise."""
    file, at = io.BytesIO(data) if isinstance(data, bytes) else data, 0
    while len(head := file.read(4)) == 4:
        (length,) = struct.unpack("<I", head)
        if not 4 < length <= MAX_LOG_RECORD_BYTES:
            raise Corrupt(f"record length {length} at byte {at}")
        rest = file.read(length)
        if len(rest) < length:
            return
        (checksum,) = struct.unpack_from("<I", rest)
        body = bytes(rest[4:])
        if zlib.crc32(body) != checksum:
            raise Corrupt(f"checksum of the record at byte {at}")
        yield _decode_body(body, at)
        at += 4 + length


def _decode_body(body: bytes, at: int) -> Record:
    try:
        seq, op, key_length = _HEAD.unpack_from(body)
        if op > 1 or key_length > len(body):
            raise Corrupt(f"operation or key length of the record at byte {at}")
        key, rest = body[13 : 13 + key_length], body[13 + key_length :]
        if len(key) < key_length:
            raise Corrupt(f"key of the record at byte {at} is cut short")
        if op:
            return seq, key, None
        (value_length,) = struct.unpack_from("<I", rest)
        if len(rest) < 4 + value_length:
            raise Corrupt(f"value of the record at byte {at} is cut short")
        return seq, key, rest[4 : 4 + value_length]
    except struct.error as error:
        raise Corrupt(f"record at byte {at} is cut short") from error


#: Records that a task holds at once.
BATCH = 4096


def named_files(files: DataFrame, path: str) -> tuple[DataFrame, Callable]:
    """``path`` (and ``content``, if tasks can't open files there) of ``binaryFile`` rows, and
    what opens one row's file in a task."""
    if scheme(path) in ARROW:
        return files.select("path"), lambda row: io.BufferedReader(opened(row["path"]), 1 << 20)
    return files.select("path", "content"), lambda row: io.BytesIO(row["content"])


def _parsed(files: DataFrame, path: str) -> DataFrame:
    files, open_ = named_files(files, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            with open_(row) as file:
                for rows in batched(decode(file), BATCH, strict=False):
                    yield pa.RecordBatch.from_pydict({"file": [row["path"]] * len(rows), "seq": [str(r[0]) for r in rows], "key": pa.array([r[1] for r in rows], pa.binary()), "value": pa.array([r[2] for r in rows], pa.binary())})

    parsed = files.mapInArrow(run, "file string, seq string, key binary, value binary")
    return parsed.select("file", F.col("seq").cast("decimal(20,0)").alias("seq"), "key", "value")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``file, seq, key, value`` of the log files at a path, a file to a task, record by record. Any
    file system that Spark reads will do (those that Arrow doesn't know for files up to 2 GB).
    Sequence numbers are DECIMAL(20): the format has unsigned ones."""
    ship(spark)
    return _parsed(spark.read.format("binaryFile").load(path), path)


def read_log_stream(spark: SparkSession, path: str, most_files: int | None = None) -> DataFrame:
    """The same as a stream of the log files that appear in a folder, under final names."""
    ship(spark)
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.wal")
    return _parsed((reader.option("maxFilesPerTrigger", most_files) if most_files else reader).load(path), path)


def write_log(log: DataFrame, path: str) -> None:
    """Adds a change log to a folder of log files, one a partition, each in seq order.
    The bytes are made in SQL; each task writes its file, batch by batch."""
    ship(log.sparkSession)
    writable_by_tasks(path)
    frames = log.sortWithinPartitions("seq").select(log_frame(F.col("seq"), F.col("key"), F.col("value")).alias("frame"))
    call = uuid.uuid4().hex[:8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name = f"part-{call}-{TaskContext.get().partitionId():05d}.wal"
        with created(path, lambda: name) as out:
            for batch in chain((first,), batches):
                out.write(b"".join(batch.column("frame").to_pylist()))
        yield pa.RecordBatch.from_pydict({"name": [name]})

    frames.mapInArrow(run, "name string").collect()  # a name a partition


class LogSource(DataSource):
    """``spark.read.format("kvwal").load(path)`` over local or mounted files, a file to a task."""

    @classmethod
    def name(cls) -> str:
        return "kvwal"

    def schema(self) -> str:
        return "file string, seq decimal(20,0), key binary, value binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LogReader(self.options)


class _LogReader(DataSourceReader):
    def __init__(self, options: dict):
        import glob
        import os

        path = options["path"].removeprefix("file://")
        found = sorted(glob.glob(f"{path}/*.wal")) if os.path.isdir(path) else sorted(glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        self.files = found

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from decimal import Decimal

        with open(partition.value, "rb") as file:
            for seq, key, value in decode(file):
                yield partition.value, Decimal(seq), key, value
