"""Point, multi-key and range reads over versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.lww import in_range, live, newest

#: Up to so many rows, asked keys are sent to every task rather than shuffled with the data.
BROADCAST_KEYS = 100_000


def get(versions: DataFrame, key: bytes | str) -> DataFrame:
    """``seq, value`` of a live key: one row or none. The test on the key reaches the scan."""
    return live(newest(versions.where(F.col("key") == F.lit(key)))).select("seq", "value")


def get_entry(versions: DataFrame, key: bytes | str) -> DataFrame:
    """As :func:`get`, with tombstones visible."""
    return newest(versions.where(F.col("key") == F.lit(key))).select("seq", "value")


def contains(versions: DataFrame, key: bytes | str) -> DataFrame:
    """``present``: whether any version of the key exists, tombstones included."""
    return versions.where(F.col("key") == F.lit(key)).limit(1).agg((F.count("*") > 0).alias("present"))


def multi_get(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, seq, value`` for each asked key; null where it is absent or deleted.

    Versions are cut to the asked keys before they are reduced. The asked keys are
    broadcast only if they are few (counted first).
    """
    asked = keys.select("key").distinct()
    few = asked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    side = F.broadcast(asked) if few else asked
    found = live(newest(versions.join(side, "key", "left_semi")))
    return asked.join(found, "key", "left").select("key", "seq", "value")


def scan(versions: DataFrame, start: bytes | str = b"", end: bytes | str = b"") -> DataFrame:
    """Live ``key, value`` of ``start <= key < end`` in key order."""
    return live(newest(versions.where(in_range(start, end)))).select("key", "value").orderBy("key")


def keys(versions: DataFrame) -> DataFrame:
    """The keys that have a version, in order."""
    return versions.select("key").distinct().orderBy("key")


def entries(versions: DataFrame) -> DataFrame:
    """The newest version of each key in key order, tombstones included."""
    return newest(versions).orderBy("key")
