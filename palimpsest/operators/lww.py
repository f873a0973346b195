"""Last writer wins: from versions to the newest version of each key.

Everything here is the first row of a window by key, which Spark cuts to one row a key in
each task before the shuffle and again behind it, so a key with any number of versions
shuffles one row a task. Filters on the key put above it reach the scans below; the
filter on tombstones must stay above it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.shared import unused


def first_of_each(rows: DataFrame, by: tuple[str, ...], order: list[Column]) -> DataFrame:
    """The first row in ``order`` of each ``by``."""
    rank = unused(rows, "_rank")
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def newest(versions: DataFrame, *first: str) -> DataFrame:
    """``key, seq, value`` of the version with the highest seq of each key, tombstones
    included. Of equal seqs the one smallest in the columns ``first`` wins: an arrival number, or
    a source's rank. Without one, equal seqs must be the same version, as in a table's own segments."""
    order = [F.desc("seq"), *(F.asc(c) for c in first)]
    return first_of_each(versions.select("key", "seq", "value", *first), ("key",), order).select("key", "seq", "value")


def first_match(versions: DataFrame, rank: str = "source_rank") -> DataFrame:
    """``key, seq, value`` from the lowest-ranked source that has the key, whatever its seq."""
    return first_of_each(versions.select("key", "seq", "value", rank), ("key",), [F.asc(rank), F.desc("seq")]).select("key", "seq", "value")


def live(current: DataFrame) -> DataFrame:
    """Rows that aren't tombstones; for reduced rows alone."""
    return current.where(F.col("value").isNotNull())


def in_range(start: Column | bytes | str | None, end: Column | bytes | str | None, key: str = "key") -> Column:
    """``start <= key < end``; an empty or missing bound is none; a start at or past the end holds no key."""
    test = F.lit(True)
    if start is not None and start not in (b"", ""):
        test = test & (F.col(key) >= F.lit(start))
    if end is not None and end not in (b"", ""):
        test = test & (F.col(key) < F.lit(end))
    return test


def ranked_union(*sources: DataFrame) -> DataFrame:
    """The versions of several sources with ``source_rank`` 0, 1, .. in the order given."""
    return reduce(DataFrame.unionByName, [s.select("key", "seq", "value", F.lit(i).alias("source_rank")) for i, s in enumerate(sources)])


def merge(*sources: DataFrame) -> DataFrame:
    """The newest version of each key over all sources; of equal seqs the earlier source's."""
    return newest(ranked_union(*sources), "source_rank")


def stale_gate(arrivals: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The state after rows arrived in order of ``arrival``: a row with a seq no higher than
    what its key has is ignored. So the highest seq wins and among equals the first to arrive."""
    return newest(arrivals, arrival)


def compacted(segments: DataFrame, memtable: DataFrame, gc: str = "full") -> DataFrame:
    """The rows of the merged segment. ``gc``: ``none`` keeps tombstones; ``as_coded`` drops
    those whose key the memtable holds; ``full`` drops all, as nothing older remains."""
    if gc == "none":
        return segments
    if gc == "full":
        return live(segments)
    if gc == "as_coded":
        held = memtable.select("key").distinct().withColumn("_held", F.lit(True))
        marked = segments.join(held, "key", "left")
        return marked.where(F.col("value").isNotNull() | F.col("_held").isNull()).select("key", "seq", "value")
    raise ValueError(f"unknown gc mode {gc!r}")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The newest version of each key no later than ``seq``."""
    return newest(log.where(F.col("seq") <= seq))
