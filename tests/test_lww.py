"""Last-writer-wins reduction, reads and counts, on literal logs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import model
from palimpsest.operators import lww, read, stats

LOG = "seq bigint, key string, value string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def log(spark, *entries):
    """Entries are (key, value or None, seq)."""
    return spark.createDataFrame([(s, k, v) for k, v, s in entries], LOG)


def state(df):
    return {r["key"]: (r["seq"], r["value"]) for r in lww.newest(df).collect()}


def test_empty_value_is_live_and_tombstone_is_not(spark):
    df = log(spark, ("a", "apple", 1), ("b", "banana", 2), ("c", "", 3), ("d", None, 4))
    assert state(df) == {"a": (1, "apple"), "b": (2, "banana"), "c": (3, ""), "d": (4, None)}
    assert rows(read.scan(df)) == [("a", "apple"), ("b", "banana"), ("c", "")]
    assert stats.max_seq(df).first()[0] == 4


@pytest.mark.parametrize(
    ("entries", "expected"),
    [
        ([("k", "v2", 5), ("k", "old", 3)], (5, "v2")),
        ([("k", "v1", 1), ("k", None, 2)], (2, None)),
        ([("k", "v1", 1), ("k", None, 2), ("k", "v2", 3)], (3, "v2")),
        ([("k", None, 5), ("k", "late", 3)], (5, None)),
    ],
)
def test_highest_seq_wins_in_any_order(spark, entries, expected):
    assert state(log(spark, *entries)) == {"k": expected}
    assert state(log(spark, *reversed(entries))) == {"k": expected}


def test_equal_seqs_first_arrival_wins(spark):
    df = spark.createDataFrame([(1, "k", "second", 1), (1, "k", "first", 0), (1, "k", None, 2)], LOG + ", arrival int")
    assert rows(lww.stale_gate(df)) == [("k", 1, "first")]


def test_merge_prefers_newer_then_earlier_source(spark):
    a, b, c = log(spark, ("a", "a1", 1), ("c", "c1", 1)), log(spark, ("b", "b2", 2), ("c", "c2", 2)), log(spark, ("c", "c3", 3), ("d", "d3", 3))
    assert sorted(rows(lww.merge(a, b, c))) == [("a", 1, "a1"), ("b", 2, "b2"), ("c", 3, "c3"), ("d", 3, "d3")]
    assert rows(lww.merge(log(spark, ("k", "x", 7)), log(spark, ("k", "y", 7)))) == [("k", 7, "x")]
    assert rows(lww.merge(log(spark, ("k", "alive", 1)), log(spark, ("k", None, 5)))) == [("k", 5, None)]


def test_first_match_trusts_rank_not_seq(spark):
    df = lww.ranked_union(log(spark, ("k", "stale", 1)), log(spark, ("k", "newer", 9)))
    assert rows(lww.first_match(df)) == [("k", 1, "stale")]
    assert rows(lww.newest(df, "source_rank")) == [("k", 9, "newer")]


def test_scan_bounds(spark):
    df = log(spark, *((c, c, i) for i, c in enumerate("abcdefg")))
    keys = lambda *b: "".join(r[0] for r in rows(read.scan(df, *b)))
    assert keys("b", "e") == "bcd"
    assert keys("e") == "efg"
    assert keys("", "c") == "ab"
    assert keys("x", "z") == keys("e", "b") == keys("c", "c") == ""
    assert keys() == "abcdefg"


def test_binary_keys_order_as_unsigned_bytes(spark):
    keys = [b"\x80", b"\x7f\x00", b"\x00\xff", b"\x7f", b"\xff"]
    df = spark.createDataFrame([(i, bytearray(k), bytearray(b"v")) for i, k in enumerate(keys)], "seq bigint, key binary, value binary")
    assert [bytes(r[0]) for r in rows(read.scan(df))] == sorted(keys)
    assert [bytes(r[0]) for r in rows(read.scan(df, b"\x7f", b"\x80"))] == [b"\x7f", b"\x7f\x00"]


def test_point_reads(spark):
    df = log(spark, ("a", "1", 1), ("b", "2", 2), ("b", None, 3))
    assert rows(read.get(df, "a")) == [(1, "1")]
    assert rows(read.get(df, "b")) == rows(read.get(df, "z")) == []
    assert rows(read.get_entry(df, "b")) == [(3, None)]
    assert [read.contains(df, k).first()[0] for k in "abz"] == [True, True, False]
    asked = spark.createDataFrame([("a",), ("b",), ("z",), ("a",)], "key string")
    assert sorted(rows(read.multi_get(df, asked))) == [("a", 1, "1"), ("b", None, None), ("z", None, None)]


def test_compaction_modes(spark):
    held = log(spark, ("a", "1", 1), ("b", None, 2), ("c", None, 3)).select("key", "seq", "value")
    memory = log(spark, ("b", "9", 9))
    out = {gc: sorted(r[0] for r in rows(lww.compacted(held, memory, gc))) for gc in ("none", "as_coded", "full")}
    assert out == {"none": ["a", "b", "c"], "as_coded": ["a", "c"], "full": ["a"]}
    with pytest.raises(ValueError):
        lww.compacted(held, memory, "other")


@pytest.mark.parametrize(
    ("entries", "size"),
    [
        ([("a", "aaa", 1), ("a", "bb", 2)], 3),
        ([("a", "aaa", 1), ("a", None, 2)], 1),
        ([("key", None, 1)], 3),
        ([("a", "1", 1), ("bb", "22", 2), ("ccc", "333", 3)], 12),
    ],
)
def test_approx_size(spark, entries, size):
    assert stats.approx_size(log(spark, *entries)).first()["approx_size"] == size


def test_many_overwrites_of_one_key(spark):
    n = 2000
    df = spark.range(n).select(F.col("id").alias("seq"), F.lit("k").alias("key"), F.when(F.col("id") % 2 == 0, "v").alias("value"))
    assert rows(lww.newest(df)) == [("k", n - 1, None)]
    assert rows(stats.approx_size(df)) == [(1, 1)]


def test_deletes_every_third(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("key"), F.when(F.col("id") % 3 != 0, "v").alias("value"))
    assert df.where("value IS NULL").count() == 334
    assert read.scan(df).count() == 666


def test_as_of(spark):
    df = log(spark, ("a", "1", 1), ("a", "2", 5), ("b", "x", 3))
    assert sorted(rows(lww.as_of(df, 4))) == [("a", 1, "1"), ("b", 3, "x")]


def simulate_levels(trigger, flushes):
    l0 = l1 = 0
    for _ in range(flushes):
        l0 += 1
        if trigger and l0 >= trigger and l0 + l1 > 1:
            l0, l1 = 0, 1
    return l0, l1


def test_level_layout_matches_simulation(spark):
    grid = spark.createDataFrame([(t, f) for t in range(8) for f in range(60)], "t int, f int")
    l0, l1 = stats.level_layout(F.col("f"), F.col("t"))
    for t, f, a, b in rows(grid.select("t", "f", l0, l1)):
        assert (a, b) == simulate_levels(t, f), (t, f)


def test_flush_points_match_a_dict(spark):
    rng = random.Random(3)
    entries = [(f"k{rng.randrange(9)}", rng.choice([None, "x" * rng.randrange(12)]), i) for i in range(400)]
    mem, expected = {}, []
    for k, v, s in entries:
        mem[k] = v
        size = sum(len(a) + len(b or "") for a, b in mem.items())
        expected.append((s, size, size >= 40))
        if size >= 40:
            mem = {}
    assert sorted(rows(stats.flush_points(log(spark, *entries), 40))) == expected


def test_random_logs_match_a_dict_and_ignore_order(spark):
    rng = random.Random(7)
    entries = [(f"k{rng.randrange(40):02d}", rng.choice([None, "", "a", "bb"]), i) for i in range(600)]
    current = {}
    for k, v, _ in entries:
        current[k] = v
    expected = sorted((k, v) for k, v in current.items() if v is not None)
    for _ in range(2):
        rng.shuffle(entries)
        df = log(spark, *entries)
        assert rows(read.scan(df)) == expected
    assert all(rows(read.get(df, k)) == ([] if v is None else [(max(s for a, _, s in entries if a == k), v)]) for k, v in list(current.items())[:5])


def test_range_filter_reaches_the_scan(spark, tmp_path):
    log(spark, ("a", "1", 1)).write.parquet(f"{tmp_path}/x")
    plan = read.scan(spark.read.parquet(f"{tmp_path}/x"), "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,a)" in plan and "LessThan(key,b)" in plan


def test_limits(spark):
    df = spark.createDataFrame([(1, "", "v"), (2, "k" * 65_536, "v"), (3, "k" * 65_537, None), (4, "k", None), (5, None, "v")], LOG)
    assert [r[0] for r in rows(df.select(model.is_valid()))] == [False, True, False, True, False]
    with pytest.raises(Exception, match="invalid record at seq"):
        model.validated(df).collect()
    for bad in (b"", b"k" * 65_537):
        with pytest.raises(model.InvalidRecord):
            model.check_key(bad)
    with pytest.raises(model.InvalidRecord):
        model.check_value(b"v" * (10 * 1024 * 1024 + 1))


def test_empty_log(spark):
    df = spark.createDataFrame([], LOG)
    assert rows(read.scan(df)) == [] and stats.max_seq(df).first()[0] == 0
    assert rows(stats.approx_size(df)) == [(0, 0)] and rows(stats.total_log_bytes(df)) == [(0,)]


def test_newest_versions_are_cut_to_one_a_key_before_the_shuffle(spark, tmp_path):
    spark.range(1000).selectExpr("cast(id % 10 as string) AS key", "id AS seq", "'v' AS value").write.parquet(str(tmp_path / "log"))
    plan = lww.newest(spark.read.parquet(str(tmp_path / "log")))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in below and "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
