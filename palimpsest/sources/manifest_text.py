"""The text manifest: a line ``L0:file`` or ``L1:file`` for each segment, newest first within a level."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.model import Corrupt
from palimpsest.sources.files import replace_file

Entry = tuple[int, str]


def parse(text: str) -> list[Entry]:
    out = []
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        level, colon, name = line.partition(":")
        if not colon:
            raise Corrupt(f"manifest line without a colon: {line!r}")
        if level not in ("L0", "L1"):
            raise Corrupt(f"unknown level {level!r}")
        out.append((int(level[1]), name.strip()))
    return out


def render(entries: Iterable[Entry]) -> str:
    return "# Segment manifest\n# Format: <level>:<filename>\n" + "".join(f"L{level}:{name}\n" for level, name in entries)


def add(entries: list[Entry], level: int, name: str) -> list[Entry]:
    """With a segment at the head of its level."""
    at = next((i for i, (lv, _) in enumerate(entries) if lv == level), len(entries))
    return [*entries[:at], (level, name), *entries[at:]]


def remove(entries: list[Entry], names: Iterable[str]) -> list[Entry]:
    gone = set(names)
    return [e for e in entries if e[1] not in gone]


def parsed_lines(lines: DataFrame, line: str = "value", number: str = "line_no") -> DataFrame:
    """``line_no, level, filename`` of manifest lines in a table; the job fails at a bad line."""
    text: Column = F.trim(F.col(line))
    wanted = lines.select(F.col(number).alias("line_no"), text.alias("_t")).where((F.length("_t") > 0) & ~F.col("_t").startswith("#"))
    level = F.regexp_extract("_t", "^L([01]):", 1)
    bad = F.raise_error(F.concat(F.lit("bad manifest line: "), F.col("_t"))).cast("int")
    return wanted.select("line_no", F.when(level != "", level.cast("int")).otherwise(bad).alias("level"), F.trim(F.regexp_extract("_t", "^L[01]:(.*)$", 1)).alias("filename"))


def read_manifest(spark: SparkSession, path: str) -> list[Entry]:
    """The entries of a manifest file on any file system; none if there is no file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return []
    return parse(spark.read.text(path, wholetext=True).first()[0])


def write_manifest(spark: SparkSession, path: str, entries: Iterable[Entry]) -> None:
    """Replaces a manifest file: a new one is written beside it and renamed onto it."""
    replace_file(spark, path, render(entries).encode())
