"""What the operators of this subpackage share: storage, Arrow slicing, memos."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.shared import delete, shared_folder, unused
from palimpsest.shipping import ship


#: Folders and catalog tables that operators have written, by application.
_written: dict[str, list[str]] = {}
_tables: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share, noted for :func:`clean`."""
    path = f"{shared_folder(spark)}/palimpsest-{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean_all)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here."""
    path = shared_path(df.sparkSession, tag)
    df.write.partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what :func:`stored` has written for these, of which nothing may be read any more."""
    for df in frames:
        delete(df.sparkSession, df.stored_at)


def clean(spark: SparkSession) -> None:
    """Deletes all folders that this application's operators have written, their results' sources
    included: for when these have been read. Happens by itself as the driver's Python ends."""
    app = spark.sparkContext.applicationId
    for name in _tables.pop(app, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in _written.pop(app, []):
        delete(spark, path)


def _clean_all() -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        if (spark := SparkSession.getActiveSession()) is not None:
            clean(spark)


def bucketed(df: DataFrame, tag: str, buckets: int, column: str) -> DataFrame:
    """``df`` written to the shared folder as a table in buckets of a column, and read back."""
    spark, name = df.sparkSession, f"palimpsest_{tag}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("path", shared_path(spark, tag)).saveAsTable(name)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


#: A set of hashes is sent to all tasks as a bitmap of 2 ** MAP_BITS bits: 8 MB, whatever their number.
MAP_BITS = 26


def bitmap(hashes: DataFrame) -> DataFrame:
    """The places of the long column of ``hashes`` in a bitmap, a row for each 4 KB of it that has one."""
    place = F.pmod(F.col(hashes.columns[0]), F.lit(1 << MAP_BITS))
    return hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map"))


def with_mark(df: DataFrame, hashed: Column, maps: DataFrame, mark: str) -> DataFrame:
    """``df`` with a boolean ``mark``: true where the place of ``hashed`` is taken, so for all rows whose
    hash was among those of the :func:`bitmap`, and few others while these are well below its
    size (with more of them the mark leaves less out, but nothing wrong). No shuffle."""
    tmp = unused(df, "__map")
    place = F.pmod(hashed, F.lit(1 << MAP_BITS))
    held = F.broadcast(maps.select(F.col("bucket").alias(f"{tmp}_bucket"), F.col("map").alias(f"{tmp}_map")))
    bit = F.bitmap_bit_position(place)
    octet = F.conv(F.hex(F.substring(f"{tmp}_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    taken = F.coalesce(octet.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0, F.lit(False))
    met = df.join(held, F.bitmap_bucket_number(place) == F.col(f"{tmp}_bucket"), "left")
    return met.withColumn(mark, taken).drop(f"{tmp}_bucket", f"{tmp}_map")


def id_text_crc(doc_id: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def bounded_batches(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """``df``, in a session that sends Python batches of about ``most`` bytes at most, so
    that long texts don't add up to large ones, and whose executors have this package."""
    ship(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.match(r"-?\d+", conf.get(key))[0]) <= most:
        conf.set(key, str(most))
    return df


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that ``column`` has about ``most`` bytes in each
    (one row at least: a longer text stays whole). What was freed meanwhile is given back at the end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            pa.default_memory_pool().release_unused()
            at = to
    give_back()  # a worker lives on for other tasks


def distinct_words(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For a list array: offsets of each list, the index of each element in the
    dictionary, and the dictionary of distinct elements."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    coded = flat.dictionary_encode()
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def ragged(flat: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Stretches of ``flat`` of the given sizes, in ``order``, one after another."""
    sizes = size[order]
    stops = np.cumsum(sizes)
    shift = (np.cumsum(size) - size)[order] - (stops - sizes)
    return flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


class Memo(dict):
    """A mapping that is emptied when it would outgrow ``most`` entries."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def missing(self, keys: list) -> list:
        """The distinct keys without an entry, after making room for all of ``keys``."""
        new = [k for k in dict.fromkeys(keys) if k not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(dict.fromkeys(keys))
        return new


def labelled_texts(docs: DataFrame, sample: DataFrame, doc_id: str, text: str) -> pa.Table:
    """``id, text, label`` for a bounded ``sample`` of ``id, label`` rows (which is broadcast),
    in order of ids. Of documents that share an id, the smallest text."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    found = rows.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return found.toArrow().sort_by("id").combine_chunks()


def give_back() -> None:
    """Returns to the system what this process has freed; allocators keep it else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def one_array(column: pa.ChunkedArray) -> pa.Array:
    """A column of strings as one array."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
