"""Change streams into tables and into keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from palimpsest.plans.table import KvTable
from palimpsest.shipping import ship
from palimpsest.sources.wal import read_log_stream

STATE = "seq bigint, value binary"
CURRENT = "key binary, seq bigint, value binary"


def read_changes(spark: SparkSession, path: str, schema: StructType | str, most_files: int | None = None) -> DataFrame:
    """The rows of Parquet files as they appear in a folder: an append-only change log."""
    reader = spark.readStream.schema(schema)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.parquet(path)


def read_log_changes(spark: SparkSession, path: str, most_files: int | None = None) -> DataFrame:
    """The same from framed log files as they appear."""
    return read_log_stream(spark, path, most_files).select(F.col("seq").cast("long").alias("seq"), "key", "value")


def flush_batches(changes: DataFrame, table: KvTable, checkpoint: str, order: tuple[str, ...] = ("seq",)) -> StreamingQuery:
    """Each micro-batch becomes a segment of ``table``: ``key, value`` rows in the order of
    ``order``. A batch that was published before a failure is not written again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.append(batch, *order, batch_id=batch_id)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Upsert(StatefulProcessor):
    """Keeps (seq, value) of each key; a row whose seq is not above it is late and ignored.

    State never expires: a tombstone must stay, or a late put with a lower seq would
    bring its key back. Emits the newest version of each key that a batch changed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("version", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.state.get() if self.state.exists() else None
        best = None if held is None else (held[0], held[1])
        changed = False
        for pdf in rows:
            at = pdf["seq"].idxmax()  # of equal ones the first
            seq, value = int(pdf["seq"][at]), pdf["value"][at]
            if best is None or seq > best[0]:
                best, changed = (seq, None if value is None else bytes(value)), True
        if changed:
            self.state.update(best)
            yield pd.DataFrame({"key": [bytes(key[0])], "seq": [best[0]], "value": [best[1]]})

    def close(self) -> None:
        pass


def upsert_state(changes: DataFrame) -> DataFrame:
    """A stream of the newest versions of changed keys, from a stream of ``key, seq, value``.
    Needs the RocksDB state store."""
    ship(changes.sparkSession)
    return changes.groupBy("key").transformWithStateInPandas(statefulProcessor=Upsert(), outputStructType=CURRENT, outputMode="Update", timeMode="None")


def fold_batches(spark: SparkSession, path: str, schema: StructType | str, table: KvTable, checkpoint: str) -> None:
    """Reads whatever a folder of change files has and flushes it; returns when done."""
    flush_batches(read_changes(spark, path, schema), table, checkpoint).awaitTermination()


def fold_log(spark: SparkSession, path: str, table: KvTable, checkpoint: str) -> None:
    """The same for a folder of framed log files."""
    flush_batches(read_log_changes(spark, path), table, checkpoint).awaitTermination()
