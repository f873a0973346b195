"""A versioned key-value table: a log tail, immutable Parquet segments in two levels,
and a manifest that publishes them.

The folder holds ``log/`` (framed records, a new file for each commit),
``segments/`` (a Parquet folder each, sorted by key, with a bloom filter on it) and
``manifest/`` (numbered files; the highest is in force). A change is published by
creating the next number, which fails if another writer did so first; whatever no
manifest names is invisible. Sequence numbers are given out on the driver.

Log and manifest files are written beside their place, forced to disk if ``durable``, and
renamed, so a crash leaves the old state or the new one. Should a file be torn all the
same (a file system whose renames aren't atomic), it is set aside when the table is
opened: a log file counts as far as its records are whole, a manifest that can't be read
was never published. Segments that a compaction has replaced stay for readers that
are at work, until :meth:`KvTable.vacuum` finds them old enough.

Writes gather in the driver's buffer, which is bounded by the flush threshold, and
each is first a log file if ``durable``. Bulk appends write a segment directly and
never pass through the driver.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions.model import CHANGE_LOG, DEFAULT_FLUSH_BYTES, DEFAULT_L0_TRIGGER, MAX_SEQ, SEGMENT, Corrupt, KvError, check_key, check_value, validated
from palimpsest.operators import lww, read
from palimpsest.shared import delete, file_system, shared_folder
from palimpsest.shipping import ship
from palimpsest.sources import manifest_text, wal
from palimpsest.sources.files import put_file
from palimpsest.sources.sst import read_segments


@dataclass(frozen=True)
class Segment:
    level: int
    name: str
    max_seq: int
    n_entries: int


@dataclass
class State:
    """What a manifest file says."""

    version: int = 0
    segments: list[Segment] = field(default_factory=list)  # newest first
    seq: int = 0  # the highest seq ever given out up to this version
    flushed_seq: int = 0  # log records up to this one are in segments
    last_batch: int = -1  # of a stream


class KvTable:
    """Opens or creates the table in a folder. Use as a context manager to flush at the end."""

    def __init__(self, spark: SparkSession, path: str, flush_threshold: int = DEFAULT_FLUSH_BYTES, l0_trigger: int = DEFAULT_L0_TRIGGER, durable: bool = True, gc: str = "full"):
        ship(spark)
        self.spark, self.path = spark, path.rstrip("/")
        self.flush_threshold, self.l0_trigger, self.durable, self.gc = flush_threshold, l0_trigger, durable, gc
        self._buffer: dict[bytes, tuple[int, bytes | None]] = {}
        self._size = 0
        self.state = self._load()
        self._seq = self.state.seq
        self._replay()

    # Files, through the file system that Spark uses for the path.

    def _files(self, folder: str) -> dict[str, float]:
        """Names, without those of unfinished files, and when each was last changed (seconds)."""
        fs, target = file_system(self.spark, f"{self.path}/{folder}")
        found = fs.listStatus(target) if fs.exists(target) else []
        return {n: s.getModificationTime() / 1000 for s in found if not (n := s.getPath().getName()).startswith(".")}

    def _names(self, folder: str) -> list[str]:
        return sorted(self._files(folder))

    def _delete(self, name: str) -> None:
        delete(self.spark, f"{self.path}/{name}")

    def _set_aside(self, name: str) -> None:
        """Renames a torn file, so that its name is free and its bytes stay."""
        fs, target = file_system(self.spark, f"{self.path}/{name}")
        fs.rename(target, file_system(self.spark, f"{self.path}/{name}.{uuid.uuid4().hex}.torn")[1])

    def _load(self) -> State:
        for name in reversed([n for n in self._names("manifest") if n.endswith(".json")]):
            text = "\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{name}").collect())
            try:
                raw = json.loads(text)
                segments = [Segment(**s) for s in raw.pop("segments")]
                state = State(segments=segments, **raw)
            except (ValueError, KeyError, TypeError):
                self._set_aside(f"manifest/{name}")  # cut off while written: never published
                continue
            present = set(self._names("segments"))
            if missing := [s.name for s in segments if s.name not in present]:
                raise Corrupt(f"segments that the manifest names are missing: {missing}")
            return state
        return State()

    def _publish(self, segments: list[Segment], flushed_seq: int, last_batch: int | None = None) -> None:
        new = State(self.state.version + 1, segments, self._seq, flushed_seq, self.state.last_batch if last_batch is None else last_batch)
        put_file(self.spark, f"{self.path}/manifest/{new.version:020d}.json", json.dumps(asdict(new)).encode(), self.durable)
        self.state = new

    def _replay(self) -> None:
        """Log files past the flushed seq refill the buffer. One without a whole record is set aside."""
        names = {n for n in self._names("log") if n.endswith(".wal") and int(n.split(".")[0]) > self.state.flushed_seq}
        if not names:
            return
        rows = wal.read_log(self.spark, f"{self.path}/log/*.wal").where(F.col("seq") > self.state.flushed_seq)
        for r in sorted(rows.toLocalIterator(), key=lambda r: r["seq"]):
            names.discard(r["file"].rsplit("/", 1)[1])
            self._apply(int(r["seq"]), bytes(r["key"]), None if r["value"] is None else bytes(r["value"]))
            self._seq = max(self._seq, int(r["seq"]))
        for n in names:
            self._set_aside(f"log/{n}")

    # Writes.

    def _apply(self, seq: int, key: bytes, value: bytes | None) -> None:
        old = self._buffer.get(key)
        if old is not None and old[0] >= seq:
            return
        self._size += len(value or b"") + (-len(old[1] or b"") if old else len(key))
        self._buffer[key] = (seq, value)

    def _write(self, key: bytes, value: bytes | None) -> None:
        if self._seq >= MAX_SEQ:
            raise KvError("sequence numbers are used up")
        seq = self._seq + 1
        if self.durable:
            put_file(self.spark, f"{self.path}/log/{seq:020d}.wal", wal.encode_record(seq, key, value), sync=True)
        self._seq = seq
        self._apply(seq, key, value)
        if self._size >= self.flush_threshold:
            self.flush()

    def set(self, key: bytes, value: bytes) -> None:
        self._write(check_key(key), check_value(value))

    def delete(self, key: bytes) -> None:
        """Writes a tombstone, whether or not the key exists."""
        self._write(check_key(key), None)

    def append(self, changes: DataFrame, *order: str, batch_id: int | None = None) -> int:
        """Writes ``key, value`` rows (null: delete) in the order of the columns ``order`` as one
        new segment; how many rows. With ``batch_id``, a batch that was published before is left out."""
        if batch_id is not None and batch_id <= self.state.last_batch:
            return 0
        self.flush()
        rows = changes.select("key", "value", *(F.col(c).alias(f"_by{i}") for i, c in enumerate(order)))
        numbered = with_seqs(validated(rows, "_by0" if order else None), tuple(f"_by{i}" for i in range(len(order))), self._seq)
        staged = f"{self.path}/segments/staged-{uuid.uuid4().hex}"
        numbered.select("key", "seq", "value").write.parquet(staged)
        delete(self.spark, numbered.stored_at)
        rows = self.spark.read.schema(SEGMENT).parquet(staged)
        n = rows.count()
        if n:
            self._seq += n
            self._add_segment(lww.newest(rows), self._seq, batch_id)
        self._delete(f"segments/{staged.rsplit('/', 1)[1]}")
        return n

    def _write_segment(self, rows: DataFrame, level: int) -> Segment | None:
        """Key-sorted Parquet; None (and no folder) if there are no rows."""
        name = uuid.uuid4().hex
        target = f"{self.path}/segments/{name}"
        ordered = rows.select("key", "seq", "value").repartitionByRange("key").sortWithinPartitions("key")
        ordered.write.option("parquet.bloom.filter.enabled#key", "true").parquet(target)
        n, top = self.spark.read.schema(SEGMENT).parquet(target).agg(F.count("*"), F.max("seq")).first()
        if not n:
            self._delete(f"segments/{name}")
            return None
        return Segment(level, name, top, n)

    def _add_segment(self, rows: DataFrame, flushed_seq: int, batch_id: int | None = None) -> None:
        made = self._write_segment(rows, 0)
        if made:
            self._publish([made, *self.state.segments], flushed_seq, batch_id)
        if self.l0_trigger and self.l0_count >= self.l0_trigger:
            self.compact()

    def flush(self) -> None:
        """Turns the buffer into a segment; nothing happens if it is empty."""
        if not self._buffer:
            return
        rows = self._tail()
        top = self._seq
        made = self._write_segment(rows, 0)
        self._publish([made, *self.state.segments], top)
        self._buffer, self._size = {}, 0
        for n in self._names("log"):
            if n.endswith(".wal") and int(n.split(".")[0]) <= top:
                self._delete(f"log/{n}")
        if self.l0_trigger and self.l0_count >= self.l0_trigger:
            self.compact()

    def compact(self) -> None:
        """Merges all segments into one of level 1. One segment or none: nothing to do."""
        old = self.state.segments
        if len(old) <= 1:
            return
        merged = lww.compacted(lww.newest(self._segments()), self._tail(), self.gc)
        made = self._write_segment(merged, 1)
        self._publish([made] if made else [], self.state.flushed_seq)

    def vacuum(self, older_than: float = 3600.0) -> list[str]:
        """Deletes segment folders that no manifest names and that haven't changed for so many seconds
        (as long as a reader or a writer of a segment may take); their names."""
        known = {s.name for s in self.state.segments}
        now = time.time()
        gone = sorted(n for n, changed in self._files("segments").items() if n not in known and now - changed >= older_than)
        for n in gone:
            self._delete(f"segments/{n}")
        return gone

    def import_segments(self, folder: str) -> int:
        """Adds the versions of foreign segment files as one segment; how many keys. The files are
        those that a text manifest in the folder names (all must exist), else all of them, newest
        name first. Which version of a key counts is told by its seq; of equal seqs the first in
        that order, and one that the table holds already before any of these."""
        entries = [n for _, n in manifest_text.read_manifest(self.spark, f"{folder}/MANIFEST")]
        fs, target = file_system(self.spark, folder)
        present = {s.getPath().getName() for s in fs.listStatus(target)}
        if missing := [n for n in entries if n not in present]:
            raise Corrupt(f"segments that the manifest names are missing: {missing}")
        names = entries or sorted((n for n in present if n.endswith(".sst")), reverse=True)
        ranks = self.spark.createDataFrame(list(enumerate(names)), "source_rank int, name string")  # a row a file
        rows = read_segments(self.spark, folder).withColumn("name", F.element_at(F.split("file", "/"), -1))
        rows = rows.join(F.broadcast(ranks), "name").select("key", F.col("seq").cast("long").alias("seq"), "value", "source_rank")
        self.flush()
        made = self._write_segment(lww.newest(rows, "source_rank").join(self._segments().select("key", "seq"), ["key", "seq"], "left_anti"), 0)
        if not made:
            return 0
        self._seq = max(self._seq, made.max_seq)
        self._publish([made, *self.state.segments], self._seq)
        return made.n_entries

    # Reads.

    def _tail(self) -> DataFrame:
        rows = [(s, bytearray(k), None if v is None else bytearray(v)) for k, (s, v) in self._buffer.items()]
        return self.spark.createDataFrame(rows, CHANGE_LOG).select("key", "seq", "value")

    def _segments(self) -> DataFrame:
        paths = [f"{self.path}/segments/{s.name}" for s in self.state.segments]
        return self.spark.read.schema(SEGMENT).parquet(*paths) if paths else self.spark.createDataFrame([], SEGMENT)

    def versions(self) -> DataFrame:
        """Every version that is still held: ``key, seq, value``."""
        return self._segments().unionByName(self._tail()) if self._buffer else self._segments()

    def get(self, key: bytes) -> tuple[int, bytes] | None:
        held = self._buffer.get(key)
        if held is not None:
            return None if held[1] is None else held
        row = read.get(self._segments(), key).first()
        return None if row is None else (row["seq"], bytes(row["value"]))

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return read.multi_get(self.versions(), keys)

    def scan(self, start: bytes = b"", end: bytes = b"") -> DataFrame:
        return read.scan(self.versions(), start, end)

    # Facts and settings.

    @property
    def seq(self) -> int:
        return self._seq

    @property
    def l0_count(self) -> int:
        return sum(s.level == 0 for s in self.state.segments)

    @property
    def l1_count(self) -> int:
        return sum(s.level == 1 for s in self.state.segments)

    @property
    def expected_entries(self) -> int:
        """How many rows a merge of all segments has at most: what the manifest counts."""
        return sum(s.n_entries for s in self.state.segments)

    @property
    def segment_count(self) -> int:
        return len(self.state.segments)

    def stats(self) -> dict[str, object]:
        return {
            "seq": self.seq, "flush_threshold": self.flush_threshold, "wal_sync": self.durable, "wal_path": f"{self.path}/log", "sst_dir": f"{self.path}/segments",
            "memtable_size": self._size, "memtable_entries": len(self._buffer), "l0_sstable_count": self.l0_count, "l1_sstable_count": self.l1_count, "l0_compaction_trigger": self.l0_trigger,
        }

    def manifest(self) -> DataFrame:
        rows = [(i, s.level, s.name, s.max_seq, s.n_entries) for i, s in enumerate(self.state.segments)]
        return self.spark.createDataFrame(rows, "ordinal int, level int, filename string, max_seq bigint, n_entries bigint")

    def close(self) -> None:
        self.flush()

    def __enter__(self) -> KvTable:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def with_seqs(rows: DataFrame, order: tuple[str, ...], start: int) -> DataFrame:
    """``rows`` with ``seq`` = ``start`` + 1, + 2, .. in the order of the columns: a range sort,
    a count for each of its partitions, and numbers within them. No task sees all rows. Rows that
    are equal in ``order`` follow each other by key and then by a hash of the whole row, so they
    are dealt out too and have the same numbers each time."""
    by = [*order, "key", "_tie"]
    tied = rows.withColumn("_tie", F.xxhash64(*rows.columns))
    placed = tied.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/palimpsest-seq-{uuid.uuid4().hex}"
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    before, firsts = start, []
    for r in sorted(placed.groupBy("_part").count().collect()):
        firsts.append((r["_part"], before))
        before += r["count"]
    first = F.broadcast(spark.createDataFrame(firsts, "_part int, _before bigint"))  # a row a partition
    own = Window.partitionBy("_part").orderBy(*by)
    numbered = placed.join(first, "_part").withColumn("seq", F.col("_before") + F.row_number().over(own))
    numbered = numbered.drop("_part", "_before", "_tie")
    numbered.stored_at = path
    return numbered
