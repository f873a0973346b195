"""Scalar functions over columns: byte encodings, checksums, hashes, sizes, text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, LongType

from palimpsest.functions.model import BLOOM_FPR

# Fixed values of the hash: its prime and the two bases that it starts from.
FNV_PRIME = 0x100000001B3
FNV_BASIS_1 = 0xCBF29CE484222325
FNV_BASIS_2 = 0x517CC1B727220A95
TWO_64 = 1 << 64


def little_endian(number: Column, width: int) -> Column:
    """The low ``width`` bytes of a non-negative number, lowest first."""
    digits = F.lpad(F.hex(number.cast("long")), 2 * width, "0")
    pairs = [F.substring(digits, 2 * (width - i) - 1, 2) for i in range(width)]
    return F.unhex(F.concat(*pairs))


def from_little_endian(data: Column, start: int, width: int) -> Column:
    """The unsigned number in ``width`` bytes from 0-based ``start``, as DECIMAL(20)."""
    pairs = [F.hex(F.substring(data, start + i + 1, 1)) for i in reversed(range(width))]
    return F.conv(F.concat(*pairs), 16, 10).cast(DecimalType(20, 0))


def log_body(seq: Column, key: Column, value: Column) -> Column:
    """The checksummed part of a log record (a null value is a delete)."""
    key, value = key.cast("binary"), value.cast("binary")
    head = F.concat(little_endian(seq, 8), F.when(value.isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), little_endian(F.octet_length(key), 4), key)
    return F.when(value.isNull(), head).otherwise(F.concat(head, little_endian(F.octet_length(value), 4), value))


def log_frame(seq: Column, key: Column, value: Column) -> Column:
    """A whole log record: length, checksum, body."""
    body = log_body(seq, key, value)
    return F.concat(little_endian(F.octet_length(body) + 4, 4), little_endian(F.crc32(body), 4), body)


def record_body(key: Column, seq: Column, value: Column) -> Column:
    """The checksummed part of a segment record."""
    key, value = key.cast("binary"), value.cast("binary")
    head = F.concat(little_endian(F.octet_length(key), 4), key, little_endian(seq, 8))
    gone = F.concat(head, F.unhex(F.lit("00")))
    return F.when(value.isNull(), gone).otherwise(F.concat(head, F.unhex(F.lit("01")), little_endian(F.octet_length(value), 4), value))


def log_bytes(key: Column, value: Column) -> Column:
    """The size of a log record: 25 bytes and both lengths for a put, 21 and the key for a delete."""
    return (F.when(value.isNull(), F.lit(21)).otherwise(F.lit(25) + F.octet_length(value)) + F.octet_length(key)).cast("long")


def record_bytes(key: Column, value: Column) -> Column:
    """The size of a checksummed segment record: 21 bytes and both lengths, or 17 and the key."""
    return (F.when(value.isNull(), F.lit(17)).otherwise(F.lit(21) + F.octet_length(value)) + F.octet_length(key)).cast("long")


def entry_bytes(key: Column, value: Column) -> Column:
    """What a version counts for in memory: its key and its value's bytes, if it is live."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def fnv1a(data: Column, basis: int = FNV_BASIS_1) -> Column:
    """FNV-1a of 64 bits as DECIMAL(20), in SQL alone. Slow: for checks; :func:`fnv1a_udf` is for bulk."""
    wide = DecimalType(20, 0)
    digits = F.hex(data.cast("binary"))
    octets = F.transform(F.sequence(F.lit(0), F.octet_length(data.cast("binary")) - 1), lambda i: F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10).cast("int"))
    octets = F.when(F.octet_length(data.cast("binary")) > 0, octets).otherwise(F.array().cast("array<int>"))

    def step(h: Column, octet: Column) -> Column:
        low = (h % F.lit(256)).cast("int")
        mixed = h - low.cast(wide) + low.bitwiseXOR(octet).cast(wide)
        product = mixed.cast(wide) * F.lit(FNV_PRIME).cast(DecimalType(13, 0))
        return (product % F.lit(str(TWO_64)).cast(DecimalType(20, 0))).cast(wide)

    return F.aggregate(octets, F.lit(str(basis)).cast(wide), step)


def fnv1a_numpy(keys: list[bytes], basis: int = FNV_BASIS_1) -> np.ndarray:
    """FNV-1a of many keys at once: one step for each byte position."""
    lengths = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    h = np.full(len(keys), basis, dtype=np.uint64)
    width = int(lengths.max(initial=0))
    padded = np.frombuffer(b"".join(k.ljust(width, b"\0") for k in keys), dtype=np.uint8).reshape(len(keys), width) if width else np.zeros((len(keys), 0), np.uint8)
    for i in range(width):
        live = lengths > i
        h[live] = (h[live] ^ padded[live, i]) * np.uint64(FNV_PRIME)
    return h


def bloom_bits(n: Column, fpr: Column | float = BLOOM_FPR) -> Column:
    """The number of bits for ``n`` items at a false-positive rate."""
    rate = fpr if isinstance(fpr, Column) else F.lit(float(fpr))
    return F.greatest(F.lit(8).cast("long"), F.ceil(-n.cast("double") * F.ln(rate) / (F.ln(F.lit(2.0)) * F.ln(F.lit(2.0)))).cast("long"))


def bloom_hashes(n: Column, fpr: Column | float = BLOOM_FPR) -> Column:
    """The number of hashes that goes with :func:`bloom_bits`."""
    return F.greatest(F.lit(1), F.ceil(bloom_bits(n, fpr).cast("double") / n.cast("double") * F.ln(F.lit(2.0))).cast("int"))


def bloom_bytes(n: Column, fpr: Column | float = BLOOM_FPR) -> Column:
    """The size of the serialised filter."""
    return F.lit(16).cast("long") + F.ceil(bloom_bits(n, fpr) / 8).cast("long")


def bit_indexes(keys: list[bytes], num_bits: int, num_hashes: int) -> np.ndarray:
    """The bits of each key, a row each: double hashing modulo 2**64, then modulo ``num_bits``."""
    one, two = fnv1a_numpy(keys, FNV_BASIS_1), fnv1a_numpy(keys, FNV_BASIS_2)
    times = np.arange(num_hashes, dtype=np.uint64)
    return ((one[:, None] + times * two[:, None]) % np.uint64(num_bits)).astype(np.int64)


def bit_indexes_udf(num_bits: int, num_hashes: int):  # noqa: ANN201
    """A pandas UDF from binary keys to their bits."""

    @F.pandas_udf(ArrayType(LongType()))
    def indexes(keys: pd.Series) -> pd.Series:
        return pd.Series(list(bit_indexes([bytes(k) for k in keys], num_bits, num_hashes)))

    return indexes


def fnv1a_udf(basis: int = FNV_BASIS_1):  # noqa: ANN201
    """A pandas UDF from binary keys to the hash's bits as a signed long."""

    @F.pandas_udf(LongType())
    def hashed(keys: pd.Series) -> pd.Series:
        return pd.Series(fnv1a_numpy([bytes(k) for k in keys], basis).view(np.int64))

    return hashed


def as_text(data: Column) -> Column:
    """Bytes as text, what isn't UTF-8 replaced."""
    return F.make_valid_utf8(data.cast("binary").cast("string"))


def segment_name(seq: Column, millis: Column) -> Column:
    """File names that sort by sequence number."""
    return F.concat(F.lit("sst-"), F.lpad(seq.cast("string"), 20, "0"), F.lit("-"), millis.cast("string"), F.lit(".sst"))


def saturating_add(a: Column, b: Column, most: int) -> Column:
    return F.least(a.cast(DecimalType(38, 0)) + b.cast(DecimalType(38, 0)), F.lit(str(most)).cast(DecimalType(38, 0)))


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a.cast(DecimalType(38, 0)) - b.cast(DecimalType(38, 0)), F.lit(0).cast(DecimalType(38, 0)))
