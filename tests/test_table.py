"""The table: flushes, levels, compaction, recovery, conflicts; the shell; streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.model import Conflict, Corrupt, InvalidRecord
from palimpsest.plans.table import KvTable, with_seqs
from palimpsest.shell import Shell, open_from_env
from palimpsest.sources import manifest_text, sst
from palimpsest.streaming import upsert

KV = "key binary, value binary, at bigint"


def scan(table, *bounds):
    return [(bytes(r["key"]), bytes(r["value"])) for r in table.scan(*bounds).collect()]


def kv(spark, *rows):
    return spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), i) for i, (k, v) in enumerate(rows)], KV)


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/table"


def test_writes_reads_and_seq(spark, path):
    t = KvTable(spark, path, durable=False)
    t.set(b"a", b"1")
    t.set(b"b", b"")
    t.delete(b"a")
    t.delete(b"never")
    assert (t.seq, t.get(b"a"), t.get(b"b"), t.get(b"x")) == (4, None, (2, b""), None)
    for bad in (lambda: t.set(b"", b"v"), lambda: t.delete(b""), lambda: t.set(b"k" * 65_537, b"v"), lambda: t.set(b"k", b"v" * (10 * 1024 * 1024 + 1))):
        with pytest.raises(InvalidRecord):
            bad()
    assert t.seq == 4
    assert scan(t) == [(b"b", b"")]
    t.flush()
    t.flush()
    assert (t.l0_count, t.l1_count, scan(t), t.get(b"a"), t.get(b"b")) == (1, 0, [(b"b", b"")], None, (2, b""))
    assert t.stats()["memtable_entries"] == 0 and t.manifest().count() == 1


def test_size_triggers_flush_and_count_triggers_compaction(spark, path):
    t = KvTable(spark, path, flush_threshold=1, l0_trigger=3, durable=False)
    for k in (b"a", b"b", b"c"):
        t.set(k, k)
    assert (t.l0_count, t.l1_count) == (0, 1)
    assert scan(t) == [(k, k) for k in (b"a", b"b", b"c")]
    t.l0_trigger = 0
    for k in (b"d", b"e", b"f"):
        t.set(k, k)
    assert (t.l0_count, t.segment_count) == (3, 4)


def test_recovery_keeps_logged_writes_and_seq(spark, path):
    t = KvTable(spark, path)
    t.set(b"a", b"1")
    t.flush()
    t.set(b"b", b"2")
    t.delete(b"a")
    again = KvTable(spark, path)  # the first was never closed
    assert (again.seq, scan(again)) == (3, [(b"b", b"2")])
    again.close()
    last = KvTable(spark, path)
    assert (last.seq, scan(last), last.stats()["memtable_entries"]) == (3, [(b"b", b"2")], 0)


def test_full_gc_keeps_seq_high_water(spark, path):
    with KvTable(spark, path, l0_trigger=0, durable=False) as t:
        t.set(b"a", b"1")
        t.flush()
        t.delete(b"a")
        t.flush()
        t.compact()
        assert (t.segment_count, scan(t)) == (0, [])
    again = KvTable(spark, path)
    assert (again.seq, again.segment_count) == (2, 0)


@pytest.mark.parametrize(("gc", "kept"), [("none", 2), ("as_coded", 2), ("full", 1)])
def test_gc_modes_over_two_segments(spark, path, gc, kept):
    t = KvTable(spark, path, l0_trigger=0, durable=False, gc=gc)
    t.set(b"a", b"1")
    t.set(b"b", b"1")
    t.flush()
    t.delete(b"a")
    t.flush()
    t.compact()
    assert t.state.segments[0].n_entries == kept
    assert scan(t) == [(b"b", b"1")] and t.get(b"a") is None


def test_scan_and_get_survive_flush_compact_and_reopening(spark, path):
    rng = random.Random(5)
    current = {}
    t = KvTable(spark, path, l0_trigger=0, durable=False)
    for i in range(60):
        k = b"k%02d" % rng.randrange(15)
        if rng.random() < 0.3:
            t.delete(k)
            current.pop(k, None)
        else:
            v = b"v%d" % i
            t.set(k, v)
            current[k] = v
        if i % 20 == 19:
            t.flush()
    expected = sorted(current.items())
    assert scan(t) == expected
    t.compact()
    assert scan(t) == expected and t.l1_count == 1
    t = KvTable(spark, path)
    assert scan(t) == expected
    for k in list(current)[:3]:
        assert t.get(k)[1] == current[k]
    asked = spark.createDataFrame([(bytearray(b"k%02d" % i),) for i in range(15)], "key binary")
    got = {bytes(r["key"]): r["value"] and bytes(r["value"]) for r in t.multi_get(asked).collect()}
    assert got == {b"k%02d" % i: current.get(b"k%02d" % i) for i in range(15)}


def test_bulk_append(spark, path):
    t = KvTable(spark, path, l0_trigger=0)
    assert t.append(kv(spark, (b"a", b"1"), (b"b", b"2"), (b"a", None)), "at") == 3
    assert (t.seq, scan(t)) == (3, [(b"b", b"2")])
    assert t.append(kv(spark, (b"c", b"3")), "at", batch_id=0) == 1
    assert t.append(kv(spark, (b"c", b"4")), "at", batch_id=0) == 0
    assert KvTable(spark, path).append(kv(spark, (b"c", b"4")), "at", batch_id=0) == 0
    assert scan(t) == [(b"b", b"2"), (b"c", b"3")]
    with pytest.raises(Exception, match="invalid record"):
        t.append(kv(spark, (b"", b"x")), "at")
    assert t.append(spark.createDataFrame([], KV), "at") == 0
    t.vacuum()
    assert KvTable(spark, path).segment_count == 2


def test_seqs_follow_the_order(spark):
    df = spark.range(1000).select(F.col("id").alias("key"), ((F.col("id") * 617) % 1000).alias("at")).repartition(7)
    rows = with_seqs(df, ("at",), 10).collect()
    assert sorted(r["seq"] for r in rows) == list(range(11, 1011))
    assert all(r["seq"] == r["at"] + 11 for r in rows)


def test_two_writers_conflict(spark, path):
    a, b = KvTable(spark, path, durable=False), KvTable(spark, path, durable=False)
    a.set(b"k", b"a")
    b.set(b"k", b"b")
    a.flush()
    with pytest.raises(Conflict):
        b.flush()
    assert scan(KvTable(spark, path)) == [(b"k", b"a")]
    assert a.vacuum() == [] and len(a.vacuum(older_than=0)) == 1
    assert scan(KvTable(spark, path)) == [(b"k", b"a")]


def test_missing_segment_is_an_error(spark, path, tmp_path):
    with KvTable(spark, path, durable=False) as t:
        t.set(b"k", b"v")
    t._delete(f"segments/{t.state.segments[0].name}")
    with pytest.raises(Corrupt):
        KvTable(spark, path)


def test_import_of_foreign_segments(spark, path, tmp_path):
    old = tmp_path / "old"
    old.mkdir()
    (old / "sst-1.sst").write_bytes(sst.encode([(b"a", 1, b"old"), (b"b", 2, b"x")], 2))
    (old / "sst-2.sst").write_bytes(sst.encode([(b"a", 7, b"new"), (b"b", 8, None)], 3))
    (old / "sst-3.sst").write_bytes(sst.encode([(b"z", 9, b"not listed")], 1))
    (old / "MANIFEST").write_text(manifest_text.render([(0, "sst-1.sst"), (1, "sst-2.sst")]))
    t = KvTable(spark, path)
    assert t.import_segments(f"file://{old}") == 2
    for _ in range(2):  # the order of files in the manifest doesn't matter, nor does reopening
        assert (t.seq, scan(t)) == (8, [(b"a", b"new")])
        t = KvTable(spark, path)
    (old / "MANIFEST").write_text(manifest_text.render([(0, "gone.sst")]))
    with pytest.raises(Corrupt):
        t.import_segments(f"file://{old}")


def test_shell(spark, path):
    script = "set a  1|SET b 2   x|SET c 3|SET d 4|DEL b|FLUSH|GET b|GET c|SCAN|SCAN b d|SET e|SET|GET|DEL|foo||SCAN x|COMPACT|EXIT|GET a".split("|")
    with KvTable(spark, path, durable=False) as t:
        said = list(Shell(t).run_all(script))
    assert said == ["OK"] * 5 + ["OK (L0=1, L1=0)", "(nil)", "3", "a -> 1", "c -> 3", "d -> 4", "(3 entries)", "c -> 3", "(1 entries)"] + ["ERR usage: SET key value"] * 2 + ["ERR usage: GET key", "ERR usage: DEL key", "unknown command: FOO", "(empty)", "OK (L0=1, L1=0)", "bye"]
    with KvTable(spark, path, durable=False) as t:
        shell = Shell(t)
        assert list(shell.run("STATS"))[0].startswith("seq: 5, flush_threshold: 1048576, wal_sync: False")
        assert list(shell.run(f"SET {'k' * 65_537} v"))[0].startswith("ERR set failed:")
        t.set(b"bytes", b"\xff")
        assert list(shell.run("GET bytes")) == ["�"]


def test_settings_from_the_environment(spark, path, monkeypatch):
    for name, value in (("KV_PATH", path), ("KV_FLUSH_KB", "2"), ("KV_LOG_SYNC", "false"), ("KV_L0_TRIGGER", "nonsense")):
        monkeypatch.setenv(name, value)
    t = open_from_env(spark)
    assert (t.path, t.flush_threshold, t.durable, t.l0_trigger) == (path, 2048, False, 4)


CHANGES = "seq bigint, key binary, value binary"


def changes(spark, rows):
    return spark.createDataFrame([(s, bytearray(k), None if v is None else bytearray(v)) for s, k, v in rows], CHANGES)


def test_stream_into_a_table_batch_by_batch(spark, path, tmp_path):
    table = KvTable(spark, path, l0_trigger=0)
    source, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    changes(spark, [(1, b"a", b"1"), (2, b"b", b"2")]).coalesce(1).write.mode("append").parquet(source)
    upsert.fold_batches(spark, source, CHANGES, table, marks)
    changes(spark, [(3, b"a", None), (4, b"c", b"3")]).coalesce(1).write.mode("append").parquet(source)
    upsert.fold_batches(spark, source, CHANGES, table, marks)
    assert (table.l0_count, scan(table)) == (2, [(b"b", b"2"), (b"c", b"3")])
    again = KvTable(spark, path)
    upsert.fold_batches(spark, source, CHANGES, again, marks)
    assert (again.seq, scan(again)) == (4, scan(table))


def test_keyed_state_ignores_late_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    batches = [[(1, b"a", b"1"), (5, b"b", None), (2, b"a", b"2")], [(3, b"b", b"late"), (1, b"a", b"late"), (6, b"c", b"x")], [(9, b"b", b"back"), (6, b"c", b"same seq")]]
    for rows in batches:
        changes(spark, rows).coalesce(1).write.mode("append").parquet(source)
    got = []
    stream = upsert.upsert_state(upsert.read_changes(spark, source, CHANGES, most_files=1))
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: got.append(sorted((bytes(r[0]), r[1], r[2] and bytes(r[2])) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
    q.awaitTermination()
    final = {k: (s, v) for batch in got for k, s, v in batch}
    assert final == {b"a": (2, b"2"), b"b": (9, b"back"), b"c": (6, b"x")}


def test_the_bloom_filter_skips_row_groups(spark, path):
    """A key between the smallest and the largest that isn't there: no row leaves the scan."""
    table = KvTable(spark, path, durable=False)
    table.append(spark.range(5000).selectExpr("cast(concat('k', lpad(id * 2, 6, '0')) as binary) AS key", "cast('v' as binary) AS value", "id AS at"), "at")
    for key, rows in ((b"k000123", 0), (b"k000124", 1)):
        found = table._segments().where(F.col("key") == F.lit(key)).select("seq")
        assert len(found.collect()) == rows
        scans, todo = [], [found._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if "FileSourceScan" in node.getClass().getSimpleName():
                scans.append(node)
            todo += [node.children().apply(i) for i in range(node.children().size())]
        read = sum(int(n.metrics().apply("numOutputRows").value()) for n in scans)
        assert (read == 0) if rows == 0 else read > 0
    assert table.get(b"k000124")[1] == b"v" and table.get(b"k000123") is None


def test_bounds_of_a_scan_reach_the_segments(spark, path):
    table = KvTable(spark, path, durable=False, l0_trigger=0)
    for at in (0, 1):
        table.append(spark.range(2000).selectExpr("cast(concat('k', lpad(id, 6, '0')) as binary) AS key", f"cast('{at}' as binary) AS value", "id AS at"), "at")
    found = table.scan(b"k000010", b"k000012")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(key), GreaterThanOrEqual(key," in plan and "LessThan(key," in plan
    assert scan(table, b"k000010", b"k000012") == [(b"k000010", b"1"), (b"k000011", b"1")]
