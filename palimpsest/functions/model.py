"""The data model: a log of versions, its limits and its errors.

A version is (seq, key, value); a null value is a tombstone, an empty one is
live. Keys are ordered as unsigned bytes, which is how Spark orders BINARY (and,
for text, STRING).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

MAX_KEY_BYTES = 65_536
MAX_VALUE_BYTES = 10 * 1024 * 1024
MAX_LOG_RECORD_BYTES = 64 * 1024 * 1024
MAX_BLOOM_BYTES = 128 * 1024 * 1024
DEFAULT_L0_TRIGGER = 4
DEFAULT_FLUSH_BYTES = 1024 * 1024
BLOOM_FPR = 0.01
MAX_SEQ = (1 << 63) - 1

CHANGE_LOG = StructType([StructField("seq", LongType(), False), StructField("key", BinaryType(), False), StructField("value", BinaryType(), True)])
SEGMENT = StructType([StructField("key", BinaryType(), False), StructField("seq", LongType(), False), StructField("value", BinaryType(), True)])
MANIFEST = StructType(
    [
        StructField("ordinal", IntegerType(), False),
        StructField("level", IntegerType(), False),
        StructField("filename", StringType(), False),
        StructField("max_seq", LongType(), True),
        StructField("n_entries", LongType(), True),
    ]
)


class KvError(Exception):
    """Anything that the engine refuses or finds broken."""


class InvalidRecord(KvError, ValueError):
    """A key or value that the limits don't allow."""


class Corrupt(KvError):
    """Bytes that can't be what they claim to be."""


class Conflict(KvError):
    """Another writer got there first."""


def check_key(key: bytes) -> bytes:
    if not key:
        raise InvalidRecord("key must not be empty")
    if len(key) > MAX_KEY_BYTES:
        raise InvalidRecord(f"key of {len(key)} bytes is longer than {MAX_KEY_BYTES}")
    return key


def check_value(value: bytes) -> bytes:
    if len(value) > MAX_VALUE_BYTES:
        raise InvalidRecord(f"value of {len(value)} bytes is longer than {MAX_VALUE_BYTES}")
    return value


def is_valid(key: str | Column = "key", value: str | Column = "value") -> Column:
    """True for rows that may be written; tombstones have no value to check. Never null."""
    key = F.col(key) if isinstance(key, str) else key
    value = F.col(value) if isinstance(value, str) else value
    key_ok = F.coalesce(F.octet_length(key).between(1, MAX_KEY_BYTES), F.lit(False))
    return key_ok & (F.coalesce(F.octet_length(value), F.lit(0)) <= MAX_VALUE_BYTES)


def validated(log: DataFrame, label: str | None = "seq") -> DataFrame:
    """``log``, failing the job at the first row that may not be written; ``label`` is the column to name it by."""
    message = F.concat(F.lit(f"invalid record at {label} "), F.coalesce(F.col(label).cast("string"), F.lit("null"))) if label else F.lit("invalid record")
    return log.withColumn("key", F.when(is_valid(), F.col("key")).otherwise(F.raise_error(message).cast(log.schema["key"].dataType)))
