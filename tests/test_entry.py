"""The driver's contract: every query runs, and agrees with its SQL."""

from __future__ import annotations

import zlib

import duckdb
import pytest

import __spark_entry__ as driver
from palimpsest import queries as kv
from palimpsest.functions.bloom import BloomFilter
from palimpsest.sources import sst, wal

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(kv.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name not in kv.SQL:
        assert rows
        return
    other = duck.sql(driver.oracle_sql()[name])
    assert sorted(other.columns) == sorted(df.columns)
    order = [other.columns.index(c) for c in sorted(other.columns)]
    expected = [tuple(r[i] for i in order) for r in other.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_checksums_against_zlib(spark):
    log = {r["key"]: r for r in kv.lww.newest(kv.change_log(spark, SF)).collect()}
    for r in kv.QUERIES["kv_record_crc"](spark, SF).collect():
        v = log[r["key"]]["value"]
        v = None if v is None else v.encode()
        frame = wal.encode_record(r["seq"], r["key"].encode(), v)
        assert r["log_crc32"] == zlib.crc32(frame[8:])
        data = sst.encode([(r["key"].encode(), r["seq"], v)])
        assert r["segment_crc32"] == int.from_bytes(data[:4], "little")


def test_false_positives_as_the_filter_has_them(spark):
    row = kv.QUERIES["kv_bloom_fpr"](spark, SF).first()
    f = BloomFilter.sized(10_000)
    f.insert([b"in:%d" % i for i in range(10_000)])
    assert row["false_positives"] == int(f.may_contain([b"out:%d" % i for i in range(10_000)]).sum()) < 300
