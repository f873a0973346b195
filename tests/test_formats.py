"""Byte formats, hashes and bloom filters."""

from __future__ import annotations

import io
import struct
import zlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.functions.bloom import BloomFilter
from palimpsest.functions.model import Corrupt
from palimpsest.sources import files, manifest_text, sst, wal

RECORDS = [(1, b"k", b"v1"), (2, b"k2", b""), (3, b"k", None), (2**64 - 1, b"\x00\xff\x80", b"\xde\xad\xbe\xef"), (0, b"", b"x")]


def frames(records=RECORDS):
    return b"".join(wal.encode_record(*r) for r in records)


def test_log_round_trip_and_sizes():
    assert list(wal.decode(frames())) == RECORDS
    assert len(wal.encode_record(1, b"abc", b"12")) == 25 + 5
    assert len(wal.encode_record(1, b"abc", None)) == 21 + 3


@pytest.mark.parametrize("tail", [b"\x01\x02", b"\x10\x00\x00\x00", wal.encode_record(9, b"key", b"value")[:-1], wal.encode_record(9, b"key", b"value")[:6]])
def test_cut_off_tail_is_dropped(tail):
    assert list(wal.decode(frames() + tail)) == RECORDS


def body_frame(body):
    return struct.pack("<II", len(body) + 4, zlib.crc32(body)) + body


@pytest.mark.parametrize(
    "bad",
    [
        frames()[:-1] + bytes([frames()[-1] ^ 1]),
        struct.pack("<I", 0) + b"\0" * 8,
        struct.pack("<I", 3) + b"\0" * 8,
        struct.pack("<I", 64 * 1024 * 1024 + 1),
        body_frame(struct.pack("<QBI", 1, 7, 1) + b"k"),
        body_frame(struct.pack("<QBI", 1, 1, 99) + b"k"),
        body_frame(struct.pack("<QBI", 1, 0, 1) + b"k" + struct.pack("<I", 50)),
        body_frame(b"short"),
    ],
)
def test_corrupt_logs(bad):
    with pytest.raises(Corrupt):
        list(wal.decode(bad))


def test_log_through_spark(spark, tmp_path):
    (tmp_path / "a.wal").write_bytes(frames())
    (tmp_path / "b.wal").write_bytes(frames(RECORDS[:1]) + b"\x05")
    spark.dataSource.register(wal.LogSource)
    for df in (wal.read_log(spark, str(tmp_path)), spark.read.format("kvwal").load(str(tmp_path))):
        got = sorted((int(r["seq"]), bytes(r["key"]), None if r["value"] is None else bytes(r["value"])) for r in df.collect())
        assert got == sorted([*RECORDS, RECORDS[0]])
    assert wal.read_log(spark, str(tmp_path)).agg(F.max("seq")).first()[0] == Decimal(2**64 - 1)


def test_written_logs_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i, bytearray(b"k%d" % i), bytearray(b"v") if i % 3 else None) for i in range(1, 50)], "seq bigint, key binary, value binary")
    wal.write_log(df, f"file://{tmp_path}/log")
    back = wal.read_log(spark, f"{tmp_path}/log").select(F.col("seq").cast("long"), "key", "value")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_sql_bytes_equal_python_bytes(spark):
    df = spark.createDataFrame([(5, bytearray(b"key"), bytearray(b"value")), (6, bytearray(b"gone"), None), (2**40, bytearray(b"k"), bytearray(b""))], "seq bigint, key binary, value binary")
    key, seq, value = F.col("key"), F.col("seq"), F.col("value")
    for r in df.select("*", scalar.log_frame(seq, key, value).alias("frame"), scalar.record_body(key, seq, value).alias("body"), scalar.record_bytes(key, value).alias("n"), scalar.log_bytes(key, value).alias("m")).collect():
        v = None if r["value"] is None else bytes(r["value"])
        assert bytes(r["frame"]) == wal.encode_record(r["seq"], bytes(r["key"]), v)
        assert r["m"] == len(r["frame"])
        file = sst.encode([(bytes(r["key"]), r["seq"], v)])
        assert file[: r["n"]] == struct.pack("<I", zlib.crc32(bytes(r["body"]))) + bytes(r["body"])
    assert spark.range(1).select(scalar.from_little_endian(F.lit(b"\x01\x00\xff\xff\xff\xff\xff\xff\xff\xff"), 2, 8)).first()[0] == Decimal(2**64 - 1)


ROWS = [(b"a", 1, b"apple"), (b"b", 2, b"banana"), (b"c", 3, b""), (b"d", 4, None)]


@pytest.mark.parametrize("version", [1, 2, 3])
def test_segments_of_every_version(version):
    data = sst.encode(ROWS, version)
    footer = sst.read_footer(files.Source(io.BytesIO(data)))
    assert (footer.version, footer.max_seq) == (version, 4 if version == 3 else None)
    assert list(sst.decode(data)) == ROWS
    assert list(sst.decode(data, b"d")) == [ROWS[3]] and list(sst.decode(data, b"zz")) == []
    assert sst.footer_pos(len(data)) == len(data) - 12 and sst.footer_pos(3) == 0


def test_broken_segments():
    good = sst.encode(ROWS)
    flipped = bytearray(good)
    flipped[20] ^= 1
    wrong_offset = good[:-12] + struct.pack("<Q", len(good)) + good[-4:]
    for bad in (b"", good[:5], good[:-4] + b"nope", bytes(flipped), wrong_offset, good[-28:]):
        with pytest.raises(Corrupt):
            list(sst.decode(bad))
    with pytest.raises(ValueError):
        sst.encode([])
    with pytest.raises(ValueError):
        sst.encode([(b"b", 1, b""), (b"a", 2, b"")])


def test_segments_through_spark(spark, tmp_path):
    for v in (1, 2, 3):
        (tmp_path / f"sst-{v:020d}-1.sst").write_bytes(sst.encode(ROWS, v))
    (tmp_path / "x.sst.tmp").write_bytes(b"left over")
    df = sst.read_segments(spark, str(tmp_path))
    assert df.count() == 12 and df.where("max_seq = 4").count() == 4
    assert sst.read_segments(spark, str(tmp_path), b"b").count() == 3
    assert [r["name"] for r in sst.list_segments(spark, str(tmp_path)).collect()] == [f"sst-{v:020d}-1.sst" for v in (3, 2, 1)]
    spark.dataSource.register(sst.SegmentSource)
    rows = spark.read.format("kvsst").load(str(tmp_path))
    assert rows.count() == 12 and rows.where(F.col("key") == F.lit(b"c")).count() == 3


def test_segments_written_by_spark(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"k%03d" % i), i, bytearray(b"v") if i % 4 else None) for i in range(200)], "key binary, seq bigint, value binary")
    names = sst.write_segments(df.repartition(5), f"file://{tmp_path}/out")
    assert all((tmp_path / "out" / n).exists() for n in names)
    back = sst.read_segments(spark, f"{tmp_path}/out").select("key", F.col("seq").cast("long"), "value")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="ascend"):
        sst.write_segments(df.union(df), f"file://{tmp_path}/bad")


def test_fnv_vectors(spark):
    assert int(scalar.fnv1a_numpy([b"a"])[0]) == 0xAF63DC4C8601EC8C
    keys = [b"", b"a", b"foobar", bytes(range(256))]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary")
    for basis in (scalar.FNV_BASIS_1, scalar.FNV_BASIS_2):
        expected = scalar.fnv1a_numpy(keys, basis).tolist()
        assert [int(r[0]) for r in df.select(scalar.fnv1a(F.col("k"), basis)).collect()] == expected
        assert [r[0] % 2**64 for r in df.select(scalar.fnv1a_udf(basis)("k")).collect()] == expected


def test_bloom_filter(spark):
    f = BloomFilter.sized(10_000)
    keys = [b"in:%d" % i for i in range(10_000)]
    f.insert(keys)
    assert f.may_contain(keys).all()
    assert f.may_contain([b"out:%d" % i for i in range(10_000)]).mean() < 0.03
    again = BloomFilter.from_bytes(f.to_bytes())
    assert (again.num_bits, again.num_hashes, again.serialized_size) == (95_851, 7, len(f.to_bytes())) and (again.bits == f.bits).all()
    row = spark.range(1).select(scalar.bloom_bits(F.lit(10_000)), scalar.bloom_hashes(F.lit(10_000)), scalar.bloom_bytes(F.lit(10_000))).first()
    assert tuple(row) == (f.num_bits, f.num_hashes, f.serialized_size)
    small = BloomFilter.sized(1, 0.5)
    assert (small.num_bits, small.num_hashes) == (8, 6)


@pytest.mark.parametrize("bad", [b"short", struct.pack("<QII", 8, 1, 256 * 1024 * 1024), struct.pack("<QII", 0, 1, 0), struct.pack("<QII", 64, 1, 1) + b"x", struct.pack("<QII", 8, 1, 1)])
def test_broken_bloom_filters(bad):
    with pytest.raises(Corrupt):
        BloomFilter.from_bytes(bad)


def test_bloom_filter_needs_sense():
    for n, p in ((0, 0.1), (1, 0.0), (1, 1.0)):
        with pytest.raises(ValueError):
            BloomFilter.sized(n, p)


def test_text_manifest(spark, tmp_path):
    entries = [(0, "b.sst"), (0, "a.sst"), (1, "z.sst")]
    text = manifest_text.render(entries)
    assert manifest_text.parse(text) == manifest_text.parse("\n# note\n" + text) == entries
    assert manifest_text.add(entries, 0, "c.sst")[0] == (0, "c.sst")
    assert manifest_text.add(entries, 1, "y.sst")[2] == (1, "y.sst")
    assert manifest_text.remove(entries, ["a.sst"]) == [(0, "b.sst"), (1, "z.sst")]
    for bad in ("no colon", "L9:x.sst"):
        with pytest.raises(Corrupt):
            manifest_text.parse(bad)
        with pytest.raises(Exception, match="bad manifest line"):
            manifest_text.parsed_lines(spark.createDataFrame([(1, bad)], "line_no int, value string")).collect()
    (tmp_path / "MANIFEST").write_text(text)
    assert manifest_text.read_manifest(spark, str(tmp_path / "MANIFEST")) == entries
    assert manifest_text.read_manifest(spark, str(tmp_path / "none")) == []
    for _ in range(2):
        entries = entries[1:]
        manifest_text.write_manifest(spark, f"file://{tmp_path}/MANIFEST", entries)
        assert manifest_text.read_manifest(spark, str(tmp_path / "MANIFEST")) == entries


def test_text_and_saturation(spark):
    df = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff"),)], "b binary")
    assert [r[0] for r in df.select(scalar.as_text(F.col("b"))).collect()] == ["ok", "�"]
    one = spark.range(1)
    assert int(one.select(scalar.saturating_add(F.lit(2**62), F.lit(2**62), 2**63 - 1)).first()[0]) == 2**63 - 1
    assert int(one.select(scalar.saturating_sub(F.lit(1), F.lit(2))).first()[0]) == 0
    assert one.select(scalar.segment_name(F.lit(5), F.lit(1700))).first()[0] == "sst-00000000000000000005-1700.sst"
