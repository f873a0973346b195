"""A bloom filter with the byte layout of segment files."""

from __future__ import annotations

import math
import struct

import numpy as np

from palimpsest.functions.model import BLOOM_FPR, MAX_BLOOM_BYTES, Corrupt
from palimpsest.functions.scalar import bit_indexes


class BloomFilter:
    def __init__(self, num_bits: int, num_hashes: int, bits: np.ndarray | None = None):
        self.num_bits, self.num_hashes = num_bits, num_hashes
        self.bits = np.zeros(-(-num_bits // 8), dtype=np.uint8) if bits is None else bits

    @classmethod
    def sized(cls, items: int, fpr: float = BLOOM_FPR) -> BloomFilter:
        if items <= 0 or not 0 < fpr < 1:
            raise ValueError("a filter needs items and a rate between 0 and 1")
        bits = max(8, math.ceil(-items * math.log(fpr) / math.log(2) ** 2))
        return cls(bits, max(1, math.ceil(bits / items * math.log(2))))

    def insert(self, keys: list[bytes]) -> None:
        at = bit_indexes(keys, self.num_bits, self.num_hashes).ravel()
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def may_contain(self, keys: list[bytes]) -> np.ndarray:
        at = bit_indexes(keys, self.num_bits, self.num_hashes)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)

    @property
    def serialized_size(self) -> int:
        return 16 + len(self.bits)

    def to_bytes(self) -> bytes:
        return struct.pack("<QII", self.num_bits, self.num_hashes, len(self.bits)) + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BloomFilter:
        if len(data) < 16:
            raise Corrupt("bloom filter header is cut short")
        bits, hashes, size = struct.unpack_from("<QII", data)
        if size > MAX_BLOOM_BYTES:
            raise Corrupt(f"bloom filter of {size} bytes is too large")
        if bits == 0 or hashes == 0 or size < -(-bits // 8):
            raise Corrupt("bloom filter's sizes don't agree")
        if len(data) < 16 + size:
            raise Corrupt("bloom filter is cut short")
        return cls(bits, hashes, np.frombuffer(data[16 : 16 + size], dtype=np.uint8).copy())
