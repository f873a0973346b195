"""The command shell: one command a line, white-space separated.

    SET key value..   GET key   DEL key   SCAN [start] [end]   COMPACT   FLUSH   STATS   EXIT

A value is the rest of the words joined by single spaces, so the shell can't
write keys with white space or empty values; the library can. Settings come from
the environment: KV_PATH, KV_FLUSH_KB, KV_LOG_SYNC, KV_L0_TRIGGER.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.model import DEFAULT_L0_TRIGGER, KvError
from palimpsest.plans.table import KvTable


def env_or(name: str, default: str) -> str:
    return os.environ.get(name, default)


def _number(text: str, default: int) -> int:
    return int(text) if text.isdecimal() else default


def open_from_env(spark: SparkSession) -> KvTable:
    """A table with the environment's settings; ones that can't be read count as unset."""
    sync = {"true": True, "false": False}.get(env_or("KV_LOG_SYNC", "true"), True)
    return KvTable(spark, env_or("KV_PATH", "kv-data"), _number(env_or("KV_FLUSH_KB", "1024"), 1024) * 1024, _number(env_or("KV_L0_TRIGGER", "4"), DEFAULT_L0_TRIGGER), sync)


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """``verb``, ``args`` (array) and ``rest`` (the value of a SET) of command lines, in SQL."""
    words = F.filter(F.split(F.col(line), r"\s+"), lambda w: w != "")
    out = lines.withColumn("_w", words)
    rest = F.array_join(F.slice("_w", 3, F.greatest(F.size("_w") - 2, F.lit(0))), " ")
    return out.withColumns({"verb": F.upper(F.get("_w", F.lit(0))), "args": F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), "rest": rest}).drop("_w")


class Shell:
    def __init__(self, table: KvTable):
        self.table = table
        self.done = False

    def _tried(self, what: str, action: Callable[[], str]) -> list[str]:
        try:
            return [action()]
        except KvError as error:
            return [f"ERR {what} failed: {error}"]

    def _levels(self, what: str, action: Callable[[], None]) -> list[str]:
        def run() -> str:
            action()
            return f"OK (L0={self.table.l0_count}, L1={self.table.l1_count})"

        return self._tried(what, run)

    def _scan(self, bounds: list[str]) -> Iterator[str]:
        start, end = (bounds + ["", ""])[:2]
        n = 0
        try:
            for row in self.table.scan(start.encode(), end.encode()).toLocalIterator():
                n += 1
                yield f"{_text(row['key'])} -> {_text(row['value'])}"
        except KvError as error:
            yield f"ERR scan failed: {error}"
            return
        yield f"({n} entries)" if n else "(empty)"

    def run(self, line: str) -> Iterable[str]:
        """The lines that a command prints."""
        words = line.split()
        if not words or self.done:
            return []
        verb, args = words[0].upper(), words[1:]
        table = self.table
        if verb == "SET":
            value = " ".join(args[1:])
            if not value:
                return ["ERR usage: SET key value"]
            return self._tried("set", lambda: table.set(args[0].encode(), value.encode()) or "OK")
        if verb == "GET":
            if not args:
                return ["ERR usage: GET key"]
            return self._tried("read", lambda: "(nil)" if (found := table.get(args[0].encode())) is None else _text(found[1]))
        if verb == "DEL":
            if not args:
                return ["ERR usage: DEL key"]
            return self._tried("del", lambda: table.delete(args[0].encode()) or "OK")
        if verb == "SCAN":
            return self._scan(args)
        if verb == "COMPACT":
            return self._levels("compact", table.compact)
        if verb == "FLUSH":
            return self._levels("flush", table.flush)
        if verb == "STATS":
            return [", ".join(f"{k}: {v}" for k, v in table.stats().items())]
        if verb in ("EXIT", "QUIT"):
            self.done = True
            return ["bye"]
        return [f"unknown command: {verb}"]

    def run_all(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            yield from self.run(line)
            if self.done:
                return


def _text(data: bytes) -> str:
    return bytes(data).decode(errors="replace")


def main() -> None:
    spark = SparkSession.builder.getOrCreate()
    with open_from_env(spark) as table:
        shell = Shell(table)
        print(f"started (seq={table.seq}, path={table.path}, flush={table.flush_threshold // 1024}KiB, l0_trigger={table.l0_trigger})")
        print("> ", end="", flush=True)
        for line in sys.stdin:
            for out in shell.run(line):
                print(out)
            if shell.done:
                break
            print("> ", end="", flush=True)


if __name__ == "__main__":
    main()
