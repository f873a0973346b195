"""Registered queries that go through :class:`KvTable`, the shell, the files and the streams.

Single writes pass the driver one by one, so what they write is the head of the change log ``L``
(its first records); bulk paths take all of it.
"""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.functions.bloom import BloomFilter
from palimpsest.operators import lww
from palimpsest.plans.table import KvTable
from palimpsest.queries import _L, _NOW, _new_path, _text, change_log, query
from palimpsest.shared import file_system
from palimpsest.shell import Shell, open_from_env
from palimpsest.sources import manifest_text, sst, wal
from palimpsest.streaming import upsert

def _head(spark: SparkSession, sf_dir: str, n: int) -> list[tuple[int, bytes, bytes | None]]:
    """The first ``n`` records, in order."""
    rows = change_log(spark, sf_dir).where(F.col("seq") <= n).orderBy("seq").collect()
    return [(r["seq"], r["key"].encode(), None if r["value"] is None else r["value"].encode()) for r in rows]


def _write(table: KvTable, records: list[tuple[int, bytes, bytes | None]]) -> None:
    for _, key, value in records:
        if value is None:
            table.delete(key)
        else:
            table.set(key, value)


def _as_of_sql(n: int) -> str:
    return f"cur AS (SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM L WHERE seq <= {n}) WHERE rn = 1)"


@query(f"WITH {_L}, {_as_of_sql(30)} SELECT key, value FROM cur WHERE value IS NOT NULL")
def kv_set_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty puts and deletes, a flush after twenty, and a scan over segment and buffer."""
    table = KvTable(spark, _new_path(spark, "table"))
    records = _head(spark, sf_dir, 30)
    _write(table, records[:20])
    table.flush()
    _write(table, records[20:])
    return table.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(f"WITH {_L}, {_as_of_sql(29)} SELECT key, value, CAST(29 AS BIGINT) AS seq FROM cur WHERE value IS NOT NULL")
def kv_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that was never closed, its last log file and its last manifest cut off, opened again."""
    path = _new_path(spark, "table")
    lost = KvTable(spark, path)
    records = _head(spark, sf_dir, 30)
    _write(lost, records[:20])
    lost.flush()
    _write(lost, records[20:])
    for name, data in ((f"log/{30:020d}.wal", wal.encode_record(*records[-1])[:11]), (f"manifest/{2:020d}.json", b'{"version": 2, "segm')):
        fs, target = file_system(spark, f"{path}/{name}")
        out = fs.create(target, True)
        out.write(bytearray(data))
        out.close()
    table = KvTable(spark, path)
    seq = table.seq
    table.flush()
    again = KvTable(spark, path)
    return again.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.lit(seq).cast("long").alias("seq"))


@query(f"WITH {_L}, {_as_of_sql(30)} SELECT k.key, cur.seq, cur.value FROM (SELECT DISTINCT key FROM L WHERE seq <= 32) k LEFT JOIN cur ON cur.key = k.key AND cur.value IS NOT NULL")
def kv_table_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point reads of every key of the first 32 records, of which thirty were written: half in a segment."""
    with KvTable(spark, _new_path(spark, "table")) as table:
        records = _head(spark, sf_dir, 32)
        _write(table, records[:15])
        table.flush()
        _write(table, records[15:30])
        found = [(k.decode(), *(table.get(k) or (None, None))) for k in sorted({k for _, k, _ in records})]
    return spark.createDataFrame([(k, s, None if v is None else v.decode()) for k, s, v in found], "key string, seq bigint, value string")


@query(f"WITH {_L}, {_NOW} SELECT key, value FROM cur WHERE value IS NOT NULL AND key >= 'user:000020' AND key < 'user:000090'")
def kv_table_scan_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of the log's keys from a table's segments; the bounds reach their Parquet scans."""
    table = KvTable(spark, _new_path(spark, "table"), l0_trigger=0)
    log = change_log(spark, sf_dir).withColumn("key", F.col("key").cast("binary")).withColumn("value", F.col("value").cast("binary"))
    half = log.agg(F.max("seq")).first()[0] // 2
    for part in (log.where(F.col("seq") <= half), log.where(F.col("seq") > half)):
        table.append(part, "seq")
    found = table.scan(b"user:000020", b"user:000090")
    return found.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(
    f"""WITH {_L}, mem AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM L WHERE seq BETWEEN 21 AND 30) WHERE rn = 1)
SELECT CAST(30 AS BIGINT) AS seq, CAST(1048576 AS BIGINT) AS flush_threshold, true AS wal_sync, 'log' AS wal_path, 'segments' AS sst_dir,
  CAST((SELECT sum(strlen(key) + coalesce(strlen(value), 0)) FROM mem) AS BIGINT) AS memtable_size, (SELECT count(*) FROM mem) AS memtable_entries,
  CAST(2 AS BIGINT) AS l0_sstable_count, CAST(0 AS BIGINT) AS l1_sstable_count, CAST(4 AS BIGINT) AS l0_compaction_trigger"""
)
def kv_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten facts of a table after two flushes and ten more writes, at the default settings."""
    table = KvTable(spark, _new_path(spark, "table"))
    records = _head(spark, sf_dir, 30)
    for part in (records[:10], records[10:20]):
        _write(table, part)
        table.flush()
    _write(table, records[20:])
    facts = {k: v.rsplit("/", 1)[1] if isinstance(v, str) else v for k, v in table.stats().items()}
    return spark.createDataFrame([tuple(facts.values())], list(facts))


@query(
    """SELECT * FROM (VALUES (0, 'three writes', 0, 0, 3, 0, 0), (1, 'flush', 1, 0, 0, 1, 3), (2, 'write and flush', 2, 0, 0, 2, 4), (3, 'compact', 0, 1, 0, 3, 3), (4, 'vacuum', 0, 1, 0, 1, 3),
  (5, 'delete all, flush', 1, 1, 0, 2, 6), (6, 'compact', 0, 0, 0, 2, 0), (7, 'vacuum', 0, 0, 0, 0, 0)) AS v(step, done, l0, l1, log_files, segment_folders, expected_entries)"""
)
def kv_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels, files and expected entries along a table's life: old segments stay until the vacuum."""
    table, rows = KvTable(spark, _new_path(spark, "table"), l0_trigger=0), []

    def note(done: str) -> None:
        rows.append((len(rows), done, table.l0_count, table.l1_count, len(table._names("log")), len(table._names("segments")), table.expected_entries))

    for k in (b"a", b"b", b"c"):
        table.set(k, b"1")
    note("three writes")
    table.flush()
    note("flush")
    table.set(b"a", b"2")
    table.flush()
    note("write and flush")
    table.compact()
    note("compact")
    table.vacuum(older_than=0)
    note("vacuum")
    for k in (b"a", b"b", b"c"):
        table.delete(k)
    table.flush()
    note("delete all, flush")
    table.compact()
    note("compact")
    table.vacuum(older_than=0)
    note("vacuum")
    return spark.createDataFrame(rows, "step int, done string, l0 int, l1 int, log_files int, segment_folders int, expected_entries int")


@query(
    """SELECT CAST(t AS INTEGER) AS trigger, CAST(f AS INTEGER) AS flushes,
  CAST(CASE WHEN t = 0 THEN f WHEN t = 1 THEN CASE WHEN f = 1 THEN 1 ELSE 0 END ELSE f % t END AS INTEGER) AS l0,
  CAST(CASE WHEN t = 0 THEN 0 WHEN t = 1 THEN CASE WHEN f > 1 THEN 1 ELSE 0 END WHEN f >= t THEN 1 ELSE 0 END AS INTEGER) AS l1
FROM range(4) AS a(t), range(1, 5) AS b(f)"""
)
def kv_levels_of_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level counts after each of four flushes, at four compaction triggers."""
    rows = []
    for trigger in range(4):
        table = KvTable(spark, _new_path(spark, "table"), l0_trigger=trigger, durable=False)
        for n in range(1, 5):
            table.set(b"k%d" % n, b"v")
            table.flush()
            rows.append((trigger, n, table.l0_count, table.l1_count))
    return spark.createDataFrame(rows, "trigger int, flushes int, l0 int, l1 int")


@query(f"WITH {_L}, {_NOW} SELECT key, value, (SELECT max(seq) FROM L) AS seq FROM cur WHERE value IS NOT NULL")
def kv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign segments of all three versions, a third of the log each, named by a text manifest, imported."""
    folder, log = _new_path(spark, "foreign"), change_log(spark, sf_dir)
    third = F.ceil(F.col("seq") * 3 / F.lit(log.agg(F.max("seq")).first()[0]))
    entries: list[manifest_text.Entry] = []
    for version in (1, 2, 3):
        for name in sst.write_segments(lww.newest(log.where(third == version)), folder, version):
            entries = manifest_text.add(entries, 0, name)
    sst.write_segments(lww.newest(log).withColumn("value", F.lit(b"not named")), folder)  # another file in the folder
    manifest_text.write_manifest(spark, f"{folder}/MANIFEST", entries)
    table = KvTable(spark, _new_path(spark, "table"))
    table.import_segments(folder)
    return table.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.lit(table.seq).cast("long").alias("seq"))


_NAMED = "'sst-' || lpad(CAST(epoch AS VARCHAR), 20, '0') || '-0.sst'"


@query(f"WITH {_L}, e AS (SELECT DISTINCT epoch FROM L) SELECT CAST(row_number() OVER (ORDER BY epoch % 2, epoch DESC) - 1 AS INTEGER) AS ordinal, CAST(epoch % 2 AS INTEGER) AS level, {_NAMED} AS filename FROM e WHERE epoch % 3 <> 1")
def kv_manifest_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every epoch's segment put at the head of its level, every third removed, saved and loaded."""
    epochs = [r[0] for r in change_log(spark, sf_dir).select("epoch").distinct().orderBy("epoch").collect()]
    name = lambda e: f"sst-{e:020d}-0.sst"
    path, entries = f"{_new_path(spark, 'manifest')}/MANIFEST", []
    for e in epochs:
        entries = manifest_text.add(entries, e % 2, name(e))
        if e % 7 == 0:
            manifest_text.write_manifest(spark, path, entries)
    manifest_text.write_manifest(spark, path, manifest_text.remove(entries, [name(e) for e in epochs if e % 3 == 1]))
    found = [(i, level, n) for i, (level, n) in enumerate(manifest_text.read_manifest(spark, path))]
    return spark.createDataFrame(found, "ordinal int, level int, filename string")


_ASKED = "('user:000000'), ('user:000003'), ('user:000007'), ('user:000149'), ('user:absent')"


@query(f"WITH {_L}, {_NOW} SELECT key, seq, value FROM cur WHERE key IN (SELECT * FROM (VALUES {_ASKED}))")
def kv_segment_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single keys out of segment files: bloom filter, index, one record."""
    path = _new_path(spark, "segments")
    sst.write_segments(lww.newest(change_log(spark, sf_dir)), path)
    keys = [k.strip("()' ").encode() for k in _ASKED.split(",")]
    found = [sst.read_segments(spark, path, k) for k in keys]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return _text(out)


@query(f"WITH {_L}, {_NOW} SELECT 'log' AS source, seq, key, value FROM L UNION ALL SELECT 'segment', seq, key, value FROM cur WHERE key = 'user:000003'")
def kv_data_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log through ``kvwal``, one key through ``kvsst``: for files that the tasks' machines mount."""
    for source in (wal.LogSource, sst.SegmentSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark plans the read when rows are asked for
    path, log = _new_path(spark, "files"), change_log(spark, sf_dir)
    wal.write_log(log, f"{path}/log")
    sst.write_segments(lww.newest(log), f"{path}/segments")
    a = _text(spark.read.format("kvwal").load(f"{path}/log")).select(F.lit("log").alias("source"), "*")
    one = spark.read.format("kvsst").load(f"{path}/segments").where(F.col("key") == F.lit(b"user:000003"))
    return a.unionByName(_text(one).select(F.lit("segment").alias("source"), "*"))


@query(f"WITH {_L}, {_NOW} SELECT key, value FROM cur WHERE value IS NOT NULL")
def kv_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as framed log files, streamed into a table and scanned."""
    folder = _new_path(spark, "log")
    log = change_log(spark, sf_dir)
    wal.write_log(log.repartitionByRange(3, "seq"), folder)
    table = KvTable(spark, _new_path(spark, "table"))
    upsert.fold_log(spark, folder, table, _new_path(spark, "marks"))
    return table.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):  # noqa: ANN202
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


@query(f"WITH {_L}, {_NOW} SELECT key, seq, value FROM cur")
def kv_upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in three shuffled files, each a micro-batch, folded into keyed state: the last of each key's changes."""
    source, sink = _new_path(spark, "stream"), _new_path(spark, "changes")
    rows = change_log(spark, sf_dir).select("seq", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    rows.repartition(3, (F.col("seq") * 7919) % 101).write.parquet(source)
    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        changed = upsert.upsert_state(upsert.read_changes(spark, source, rows.schema, most_files=1))
        keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(sink)
        changed.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", _new_path(spark, "marks")).trigger(availableNow=True).start().awaitTermination()
    last = lww.first_of_each(spark.read.parquet(sink), ("key",), [F.desc("batch")])
    return _text(last.select("seq", "key", "value"))


@query(f"WITH {_L} SELECT key, true AS may_contain FROM (SELECT DISTINCT key FROM L)")
def kv_bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key asked of a filter that all were put into and that went through its bytes."""
    keys = sorted(r[0].encode() for r in change_log(spark, sf_dir).select("key").distinct().collect())
    made = BloomFilter.sized(len(keys))
    made.insert(keys)
    held = BloomFilter.from_bytes(made.to_bytes())
    return spark.createDataFrame([(k.decode(), bool(m)) for k, m in zip(keys, held.may_contain(keys), strict=True)], "key string, may_contain boolean")


_U64 = "18446744073709551615"


@query(f"SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, CAST(least(CAST(a AS HUGEINT) + b, {_U64}) AS VARCHAR) AS total, CAST(greatest(CAST(a AS HUGEINT) - b, 0) AS VARCHAR) AS rest FROM (VALUES (CAST(0 AS UBIGINT)), (7), ({_U64})) AS x(a), (VALUES (CAST(1 AS UBIGINT)), (7), ({_U64})) AS y(b)")
def kv_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and differences that stop at the ends of an unsigned 64-bit number."""
    grid = spark.createDataFrame([(a, b) for a in ("0", "7", _U64) for b in ("1", "7", _U64)], "a string, b string")
    return grid.select("a", "b", scalar.saturating_add(F.col("a"), F.col("b"), int(_U64)).cast("string").alias("total"), scalar.saturating_sub(F.col("a"), F.col("b")).cast("string").alias("rest"))


@query("SELECT * FROM (VALUES ('6162', 'ab'), ('61FF62', 'a\N{REPLACEMENT CHARACTER}b'), ('C3A9', 'é'), ('C3', '\N{REPLACEMENT CHARACTER}'), ('', '')) AS v(octets, text)")
def kv_lossy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes shown as text: what isn't UTF-8 is replaced."""
    rows = spark.createDataFrame([(h,) for h in ("6162", "61FF62", "C3A9", "C3", "")], "octets string")
    return rows.select("octets", scalar.as_text(F.unhex("octets")).alias("text"))


@query(f"WITH {_L} SELECT 'sst-' || lpad(CAST(epoch AS VARCHAR), 20, '0') || '.sst' AS name, CAST(epoch + 1 AS BIGINT) AS length FROM (SELECT DISTINCT epoch FROM L)")
def kv_list_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment files of a folder without a manifest, and what else lies there is left out."""
    path = _new_path(spark, "folder")
    fs, _ = file_system(spark, path)
    for (e,) in change_log(spark, sf_dir).select("epoch").distinct().collect():
        for name in (f"sst-{e:020d}.sst", f"{e}.txt"):
            out = fs.create(file_system(spark, f"{path}/{name}")[1], False)
            out.write(bytearray(e + 1))
            out.close()
    return sst.list_segments(spark, path)


_SCRIPT = ["SET a  1", "set b 2   x", "SET c 3", "SET d 4", "GET b", "DEL b", "FLUSH", "GET b", "GET c", "SCAN", "SCAN b d", "SCAN x", "SET e", "GET", "DEL", "FOO", "", "SET a 9", "COMPACT", "FLUSH", "COMPACT", "GET a", "EXIT", "GET a"]
_SAID = [
    "OK", "OK", "OK", "OK", "2 x", "OK", "OK (L0=1, L1=0)", "(nil)", "3", "a -> 1", "c -> 3", "d -> 4", "(3 entries)", "c -> 3", "(1 entries)", "(empty)",
    "ERR usage: SET key value", "ERR usage: GET key", "ERR usage: DEL key", "unknown command: FOO", "OK", "OK (L0=1, L1=0)", "OK (L0=2, L1=0)", "OK (L0=0, L1=1)", "9", "bye",
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{line}')" for i, line in enumerate(_SAID)) + ") AS v(line_no, line)")
def kv_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shell prints for a script, on a table opened with settings from the environment."""
    mine = {"KV_PATH": _new_path(spark, "shell"), "KV_FLUSH_KB": "64", "KV_LOG_SYNC": "true", "KV_L0_TRIGGER": "0"}
    before = {k: os.environ.get(k) for k in mine}
    os.environ.update(mine)
    try:
        with open_from_env(spark) as table:
            said = list(Shell(table).run_all(_SCRIPT))
    finally:
        for k, v in before.items():
            os.environ.pop(k) if v is None else os.environ.update({k: v})
    return spark.createDataFrame(list(enumerate(said)), "line_no int, line string")


