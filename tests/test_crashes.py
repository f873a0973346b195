"""What a crash may leave behind, and readers at work while segments are replaced."""

from __future__ import annotations

from pathlib import Path

import pytest

from palimpsest.functions.model import Conflict
from palimpsest.plans.table import KvTable, with_seqs
from palimpsest.sources import files, manifest_text, sst, wal
from palimpsest.streaming import upsert


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/table"


def scan(table):
    return [(bytes(r["key"]), bytes(r["value"])) for r in table.scan().collect()]


def cut(file, to):
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    file.write_bytes(file.read_bytes()[:to])


@pytest.mark.parametrize("to", [0, 3, 9, -1])
def test_writing_goes_on_after_a_torn_log(spark, path, tmp_path, to):
    t = KvTable(spark, path)
    t.set(b"a", b"1")
    t.set(b"b", b"2")
    (log,) = (tmp_path / "table/log").glob("*2.wal")
    cut(log, to)
    again = KvTable(spark, path)
    assert (again.seq, scan(again)) == (1, [(b"a", b"1")])
    again.set(b"c", b"3")
    again.set(b"d", b"4")
    last = KvTable(spark, path)
    assert (last.seq, scan(last)) == (3, [(b"a", b"1"), (b"c", b"3"), (b"d", b"4")])
    last.close()
    assert scan(KvTable(spark, path)) == [(b"a", b"1"), (b"c", b"3"), (b"d", b"4")]


@pytest.mark.parametrize("to", [0, 20, -3])
def test_a_torn_manifest_was_never_published(spark, path, tmp_path, to):
    t = KvTable(spark, path, l0_trigger=0)
    t.set(b"a", b"1")
    t.flush()
    t.set(b"b", b"2")
    t.flush()
    cut(sorted((tmp_path / "table/manifest").glob("*.json"))[-1], to)
    again = KvTable(spark, path, l0_trigger=0)
    assert (again.state.version, scan(again)) == (1, [(b"a", b"1")])  # its log had been dropped after the flush
    again.set(b"c", b"3")
    again.flush()
    assert scan(KvTable(spark, path)) == [(b"a", b"1"), (b"c", b"3")]


def test_unfinished_files_are_not_seen(spark, path, tmp_path):
    t = KvTable(spark, path)
    t.set(b"a", b"1")
    for folder, name in (("log", ".00000000000000000002.wal.x.tmp"), ("manifest", ".00000000000000000001.json.x.tmp")):
        (tmp_path / "table" / folder).mkdir(exist_ok=True)
        (tmp_path / "table" / folder / name).write_bytes(b"half")
    again = KvTable(spark, path)
    again.set(b"b", b"2")
    again.flush()
    assert scan(KvTable(spark, path)) == [(b"a", b"1"), (b"b", b"2")]


def test_the_second_writer_of_a_log_file_is_told(spark, path):
    a, b = KvTable(spark, path), KvTable(spark, path)
    a.set(b"k", b"a")
    with pytest.raises(Conflict):
        b.set(b"k", b"b")
    assert b.seq == 0 and scan(KvTable(spark, path)) == [(b"k", b"a")]


def test_a_scan_is_held_over_a_compaction(spark, path):
    t = KvTable(spark, path, l0_trigger=0)
    for i in range(3):
        t.set(b"k%d" % i, b"v")
        t.flush()
    held = t.scan()
    t.compact()
    assert t.segment_count == t.expected_entries - 2 == 1
    assert len(held.collect()) == 3 and t.vacuum() == []
    assert len(t.vacuum(older_than=0)) == 3 and len(scan(t)) == 3


def test_a_manifest_is_replaced_at_once(spark, tmp_path):
    at = f"file://{tmp_path}/MANIFEST"
    for entries in ([(0, "a.sst")], [(0, "b.sst"), (1, "a.sst")], []):
        manifest_text.write_manifest(spark, at, entries)
        assert manifest_text.read_manifest(spark, at) == entries
    assert [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == ["MANIFEST"]


def test_equal_seqs_of_imported_files(spark, path, tmp_path):
    """The first file in order wins; what the table holds wins before any."""
    folder = tmp_path / "old"
    folder.mkdir()
    (folder / "sst-1.sst").write_bytes(sst.encode([(b"a", 1, b"zz older file"), (b"b", 7, b"zz older file")]))
    (folder / "sst-2.sst").write_bytes(sst.encode([(b"b", 7, b"newer file"), (b"c", 9, b"c")]))
    t = KvTable(spark, path)
    t.set(b"a", b"own")
    t.import_segments(f"file://{folder}")
    assert scan(t) == [(b"a", b"own"), (b"b", b"newer file"), (b"c", b"c")] and t.seq == 9


@pytest.fixture
def many_partitions(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_rows_of_one_order_value_are_dealt_out(spark, many_partitions):
    rows = spark.range(3000).selectExpr("cast(concat('k', id % 50) as binary) AS key", "cast(concat('v', id) as binary) AS value", "7 AS at")
    a, b = (with_seqs(r, ("at",), 0).collect() for r in (rows, rows.repartition(7)))
    assert sorted(r["seq"] for r in a) == list(range(1, 3001))
    assert sorted((r["seq"], bytes(r["value"])) for r in a) == sorted((r["seq"], bytes(r["value"])) for r in b)
    placed = spark.read.parquet(with_seqs(rows, ("at",), 0).stored_at)
    assert placed.select("_part").distinct().count() > 1


def test_tasks_write_logs_and_segments(spark, tmp_path, many_partitions):
    rows = spark.range(1, 2001).selectExpr("id AS seq", "cast(concat('k', lpad(id, 5, '0')) as binary) AS key", "if(id % 3 = 0, NULL, cast(repeat('v', 1000) as binary)) AS value").repartition(4)
    for _ in range(2):  # a second call adds files
        wal.write_log(rows, f"file://{tmp_path}/log")
    names = [f.name for f in (tmp_path / "log").iterdir()]
    assert len(names) == 8 and all(n.startswith("part-") for n in names)
    assert wal.read_log(spark, f"file://{tmp_path}/log").distinct().count() == wal.read_log(spark, f"file://{tmp_path}/log").count() == 4000
    made = sst.write_segments(rows, f"file://{tmp_path}/seg")
    assert sorted(made) == sorted(f.name for f in (tmp_path / "seg").iterdir()) and len(made) > 1
    got = sst.read_segments(spark, f"file://{tmp_path}/seg")
    assert got.count() == 2000 and got.where("value is null").count() == 666
    with pytest.raises(ValueError):
        wal.write_log(rows, "viewfs://store/log")


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, file):
        self.file, self.read_bytes = file, 0

    def seek(self, *a):
        return self.file.seek(*a)

    def read(self, n):
        data = self.file.read(n)
        self.read_bytes += len(data)
        return data


def test_one_key_reads_a_small_part_of_a_segment(tmp_path):
    big = tmp_path / "big.sst"
    with big.open("wb") as out:
        sst.write_segment(out, ((b"k%06d" % i, i, b"v" * 20_000) for i in range(2000)))
    for key, found in ((b"k001234", 1), (b"absent", 0)):
        with big.open("rb") as f:
            file = Counted(f)
            assert len(list(sst.decode(file, key))) == found
            assert file.read_bytes < 6 * files.BLOCK < big.stat().st_size / 5


def test_a_stream_of_log_files(spark, path, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    table = KvTable(spark, path, l0_trigger=0)
    for i, records in enumerate([[(1, b"a", b"1"), (2, b"b", b"2")], [(3, b"a", None), (4, b"c", b"4")]]):
        (folder / f"{i}.wal").write_bytes(b"".join(wal.encode_record(*r) for r in records) + b"\x09\x00")  # and a torn tail
        upsert.fold_log(spark, f"file://{folder}", table, f"file://{tmp_path}/marks")
    assert (table.l0_count, scan(table)) == (2, [(b"b", b"2"), (b"c", b"4")])
    assert Path(tmp_path / "table/manifest").exists()
