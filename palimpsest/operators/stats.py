"""Sizes and counts of logs, segments and levels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scalar import entry_bytes, log_bytes, record_bytes
from palimpsest.operators.lww import newest


def max_seq(rows: DataFrame) -> DataFrame:
    """``max_seq``: the highest seq, 0 without rows."""
    return rows.agg(F.coalesce(F.max("seq"), F.lit(0)).cast("long").alias("max_seq"))


def recovered_seq(*sources: DataFrame) -> DataFrame:
    """``seq``: the highest over a log and all segments."""
    tops = [max_seq(s) for s in sources]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out.agg(F.max("max_seq").alias("seq"))


def approx_size(versions: DataFrame) -> DataFrame:
    """``entries, approx_size`` of the newest versions: key bytes, and value bytes of live ones."""
    sized = newest(versions).agg(F.count("*").alias("entries"), F.sum(entry_bytes(F.col("key"), F.col("value"))).alias("size"))
    return sized.select("entries", F.coalesce("size", F.lit(0)).cast("long").alias("approx_size"))


def segment_stats(segments: DataFrame, by: str) -> DataFrame:
    """``n_entries, max_seq, min_key, max_key, record_bytes`` of each segment (one version a key)."""
    return segments.groupBy(by).agg(
        F.count("*").alias("n_entries"),
        F.max("seq").alias("max_seq"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.sum(record_bytes(F.col("key"), F.col("value"))).cast("long").alias("record_bytes"),
    )


def total_log_bytes(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.sum(log_bytes(F.col("key"), F.col("value"))), F.lit(0)).cast("long").alias("log_bytes"))


def read_amplification(segments: DataFrame, by: str) -> DataFrame:
    """``key, n_segments``: how many segments hold each key."""
    return segments.select("key", by).distinct().groupBy("key").agg(F.count("*").alias("n_segments"))


def level_layout(flushes: Column, trigger: Column) -> tuple[Column, Column]:
    """(segments in level 0, in level 1) after so many flushes at a compaction trigger.

    Trigger 0 never compacts. At 1 a lone segment has nothing to merge with, so the
    first stays where it is; every later flush is merged at once.
    """
    l0 = F.when(trigger == 0, flushes).when(trigger == 1, F.when(flushes == 1, 1).otherwise(0)).otherwise(flushes % F.when(trigger > 1, trigger).otherwise(1))
    l1 = F.when(trigger == 0, 0).when(trigger == 1, (flushes > 1).cast("int")).otherwise((flushes >= trigger).cast("int"))
    return l0.cast("int"), l1.cast("int")


def flush_points(log: DataFrame, threshold: int) -> DataFrame:
    """``seq, memtable_size, flush`` of each record, flushing when the size reaches ``threshold``.

    What a record adds depends on whether its key was written since the last flush,
    so the sizes are a fold over the whole log: earlier sizes of a key come from
    window functions in parallel, and only narrow integer rows go through one task
    in order. For planning and tests; a table flushes by its own running size.
    """
    key = Window.partitionBy("key").orderBy("seq")
    size = F.coalesce(F.octet_length("value"), F.lit(0)).cast("long")
    rows = log.select("key", "seq", F.octet_length("key").cast("long").alias("k"), size.alias("v"))
    rows = rows.select("seq", "k", "v", F.lag("seq").over(key).alias("before"), F.lag("v").over(key).alias("had"), F.lit(0).alias("_all"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        since, held, sizes, flushed = -1, 0, [], []
        for seq, k, v, before, had in zip(pdf["seq"], pdf["k"], pdf["v"], pdf["before"], pdf["had"], strict=True):
            held += v - had if before > since else k + v
            sizes.append(held)
            flushed.append(held >= threshold)
            if held >= threshold:
                since, held = seq, 0
        return pd.DataFrame({"seq": pdf["seq"], "memtable_size": sizes, "flush": flushed})

    return rows.fillna(-1, ["before"]).fillna(0, ["had"]).groupBy("_all").applyInPandas(fold, "seq bigint, memtable_size bigint, flush boolean")
