"""The sorted segment format, versions 1 to 3: decoding, encoding, a Spark data source.

A file is records, then (from version 2) a bloom filter, then an index of
``key length u32 | key | offset u64``, then a footer whose last four bytes tell the
version. Version 3 puts a checksum before each record and the highest seq into
the footer. All little-endian.
"""

from __future__ import annotations

import io
import struct
import time
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import batched, chain
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from palimpsest.functions.bloom import BloomFilter
from palimpsest.functions.model import BLOOM_FPR, MAX_KEY_BYTES, MAX_VALUE_BYTES, Corrupt
from palimpsest.shipping import ship
from palimpsest.sources.files import Source, created, writable_by_tasks
from palimpsest.sources.wal import BATCH, named_files

# Fixed values of the format: magic numbers by version, and footer sizes.
MAGIC = {1: 0x53535431, 2: 0x53535432, 3: 0x53535433}
FOOTER_BYTES = {1: 12, 2: 20, 3: 28}
_VERSION = {magic: version for version, magic in MAGIC.items()}


@dataclass(frozen=True)
class Footer:
    version: int
    index_offset: int
    bloom_offset: int | None = None
    max_seq: int | None = None

    @property
    def size(self) -> int:
        return FOOTER_BYTES[self.version]

    @property
    def has_checksums(self) -> bool:
        return self.version >= 3

    def to_bytes(self) -> bytes:
        fields = [x for x in (self.max_seq, self.bloom_offset, self.index_offset) if x is not None]
        return struct.pack(f"<{len(fields)}QI", *fields, MAGIC[self.version])


def footer_pos(size: int) -> int:
    """Where a version 1 footer starts."""
    return max(0, size - FOOTER_BYTES[1])


def read_footer(data: Source) -> Footer:
    tail = data.at(max(0, data.size - FOOTER_BYTES[3]), FOOTER_BYTES[3])
    if len(tail) < FOOTER_BYTES[1]:
        raise Corrupt("segment file is too small")
    (magic,) = struct.unpack("<I", tail[-4:])
    version = _VERSION.get(magic)
    if version is None:
        raise Corrupt(f"unknown magic number {magic:#010x}")
    size = FOOTER_BYTES[version]
    if len(tail) < size:
        raise Corrupt("segment file is too small for its version")
    fields = struct.unpack_from(f"<{(size - 4) // 8}Q", tail, len(tail) - size)
    index = fields[-1]
    if index >= data.size:
        raise Corrupt("index lies past the end of the file")
    return Footer(version, index, fields[-2] if version > 1 else None, fields[0] if version > 2 else None)


def read_index(data: Source, footer: Footer) -> Iterator[tuple[bytes, int]]:
    """(key, offset) of each record, in key order."""
    at, stop = footer.index_offset, data.size - footer.size
    while at < stop:
        if at + 4 > stop:
            raise Corrupt("index is cut short")
        (length,) = struct.unpack("<I", data.at(at, 4))
        if length > MAX_KEY_BYTES:
            raise Corrupt(f"index key of {length} bytes")
        if at + 12 + length > stop:
            raise Corrupt("index is cut short")
        entry = data.at(at + 4, length + 8)
        yield entry[:length], *struct.unpack_from("<Q", entry, length)
        at += 12 + length


def read_bloom(data: Source, footer: Footer) -> BloomFilter | None:
    return None if footer.bloom_offset is None else BloomFilter.from_bytes(data.at(footer.bloom_offset, max(0, footer.index_offset - footer.bloom_offset)))


def read_record(data: Source, at: int, key: bytes, footer: Footer) -> tuple[int, bytes | None]:
    """(seq, value) of the record that the index has for a key; checked against both."""
    start = at + 4 * footer.has_checksums
    try:
        (length,) = struct.unpack("<I", data.at(start, 4))
        if length > MAX_KEY_BYTES:
            raise Corrupt(f"key of {length} bytes at byte {at}")
        if data.at(start + 4, length) != key:
            raise Corrupt(f"index points to another key at byte {at}")
        seq, present = struct.unpack("<QB", data.at(start + 4 + length, 9))
        end, value = start + 13 + length, None
        if present == 1:
            (size,) = struct.unpack("<I", data.at(end, 4))
            if size > MAX_VALUE_BYTES:
                raise Corrupt(f"value of {size} bytes at byte {at}")
            value, end = data.at(end + 4, size), end + 4 + size
            if len(value) < size:
                raise Corrupt(f"value at byte {at} is cut short")
        if footer.has_checksums and zlib.crc32(data.at(start, end - start)) != struct.unpack("<I", data.at(at, 4))[0]:
            raise Corrupt(f"checksum of the record at byte {at}")
    except struct.error as error:
        raise Corrupt(f"record at byte {at} is cut short") from error
    return seq, value


def decode(data: bytes | BinaryIO, key: bytes | None = None) -> Iterator[tuple[bytes, int, bytes | None]]:
    """(key, seq, value) in key order. Of one key only: the bloom filter is passed first, then the index
    read up to the key, and then one record.

    Index and records are read side by side, a block of each in memory.
    """
    file = io.BytesIO(data) if isinstance(data, bytes) else data
    index, records = Source(file), Source(file)
    footer = read_footer(index)
    if key is not None:
        bloom = read_bloom(index, footer)
        if bloom is not None and not bloom.may_contain([key])[0]:
            return
    for k, at in read_index(index, footer):
        if key is None or k == key:
            yield (k, *read_record(records, at, k, footer))
        elif k > key:
            return


def write_segment(out: BinaryIO, rows: Iterable[tuple[bytes, int, bytes | None]], version: int = 3, fpr: float = BLOOM_FPR) -> int:
    """Writes a segment file of (key, seq, value) rows, each key once, in key order; the highest seq.
    Records are written as they come; keys and offsets are held for the end."""
    index, top, last, at = [], 0, None, 0
    for key, seq, value in rows:
        if last is not None and key <= last:
            raise ValueError("keys must ascend")
        last, top = key, max(top, seq)
        body = struct.pack("<I", len(key)) + key + struct.pack("<QB", seq, value is not None)
        if value is not None:
            body += struct.pack("<I", len(value)) + value
        record = (struct.pack("<I", zlib.crc32(body)) if version > 2 else b"") + body
        index.append((key, at))
        at += out.write(record)
    if not index:
        raise ValueError("a segment must not be empty")
    bloom_at = at
    if version > 1:
        bloom = BloomFilter.sized(len(index), fpr)
        bloom.insert([k for k, _ in index])
        at += out.write(bloom.to_bytes())
    for key, offset in index:
        out.write(struct.pack("<I", len(key)) + key + struct.pack("<Q", offset))
    out.write(Footer(version, at, bloom_at if version > 1 else None, top if version > 2 else None).to_bytes())
    return top


def encode(rows: Iterable[tuple[bytes, int, bytes | None]], version: int = 3, fpr: float = BLOOM_FPR) -> bytes:
    """The same as bytes."""
    out = io.BytesIO()
    write_segment(out, rows, version, fpr)
    return out.getvalue()


def read_segments(spark: SparkSession, path: str, key: bytes | None = None) -> DataFrame:
    """``file, version, max_seq, key, seq, value`` of the ``.sst`` files in a folder, a file
    to a task, from any file system that Spark reads (those that Arrow doesn't know for files up
    to 2 GB). ``max_seq`` comes from the footer (version 3) or is null."""
    ship(spark)
    files, open_ = named_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(path), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            with open_(row) as file:
                footer = read_footer(Source(file))
                top = None if footer.max_seq is None else str(footer.max_seq)
                for rows in batched(decode(file, key), BATCH, strict=False):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "file": [row["path"]] * len(rows), "version": pa.array([footer.version] * len(rows), pa.int32()), "max_seq": pa.array([top] * len(rows), pa.string()),
                            "key": pa.array([r[0] for r in rows], pa.binary()), "seq": pa.array([str(r[1]) for r in rows], pa.string()), "value": pa.array([r[2] for r in rows], pa.binary()),
                        }
                    )

    parsed = files.mapInArrow(run, "file string, version int, max_seq string, key binary, seq string, value binary")
    wide = lambda c: F.col(c).cast("decimal(20,0)").alias(c)
    return parsed.select("file", "version", wide("max_seq"), "key", wide("seq"), "value")


def write_segments(rows: DataFrame, path: str, version: int = 3) -> list[str]:
    """Writes ``key, seq, value`` rows (each key once) as segment files over disjoint key
    ranges, one a partition, each by its task; their names: the highest seq, then a number that
    tells calls and partitions apart."""
    ship(rows.sparkSession)
    writable_by_tasks(path)
    binary = rows.select(F.col("key").cast("binary").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("value").cast("binary").alias("value"))
    placed = binary.repartitionByRange("key").sortWithinPartitions("key")
    call = int(time.time() * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triples = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "seq", "value")), strict=True))
        first = next(triples, None)
        if first is None:
            return
        name = lambda: f"sst-{top:020d}-{call}{TaskContext.get().partitionId():06d}.sst"  # noqa: E731  the highest seq is known at the end
        with created(path, name) as out:
            top = write_segment(out, chain((first,), triples), version)
        yield pa.RecordBatch.from_pydict({"name": [name()]})

    return [r["name"] for r in placed.mapInArrow(run, "name string").collect()]  # a name a partition


def list_segments(spark: SparkSession, path: str) -> DataFrame:
    """``name, length`` of the ``.sst`` files in a folder, newest name first (for folders without a manifest)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length").orderBy(F.desc("name"))


class SegmentSource(DataSource):
    """``spark.read.format("kvsst").load(path)`` over local or mounted files. With
    ``spark.sql.python.filterPushdown.enabled`` an equality on the key passes the bloom
    filters and reads one record a file."""

    @classmethod
    def name(cls) -> str:
        return "kvsst"

    def schema(self) -> str:
        return "file string, key binary, seq decimal(20,0), value binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SegmentReader(self.options)


class _SegmentReader(DataSourceReader):
    def __init__(self, options: dict):
        import glob
        import os

        path = options["path"].removeprefix("file://")
        self.files = sorted(glob.glob(f"{path}/*.sst")) if os.path.isdir(path) else sorted(glob.glob(path))
        if not self.files:
            raise FileNotFoundError(path)
        self.key: bytes | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",) and self.key is None:
                self.key = bytes(f.value)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from decimal import Decimal

        with open(partition.value, "rb") as file:
            for key, seq, value in decode(file, self.key):
                yield partition.value, key, Decimal(seq), value
