"""Elias-Fano coding of a non-decreasing sequence, with a select directory for random access.

An empty sequence has no values; equal neighbours are kept, each in its place; negative values are offsets from the first.
"""

from __future__ import annotations

import struct

import numpy as np

#: Ones between two entries of the select directory.
STEP = 256
#: Values whose low bits are spread out at a time.
CELLS = 1 << 16
HEAD = struct.Struct("<4sBxxxQQQ")


class EliasFano:
    """Values v[0] <= v[1] <= ...: the low bits of each packed, the high bits in unary, in about 2 + log2(u / n) bits each."""

    def __init__(self, n: int, low_bits: int, base: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.low_bits, self.base, self.low, self.high, self.directory = n, low_bits, base, low, high, directory

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        n, base = len(values), int(values[0]) if len(values) else 0
        v = (np.asarray(values, np.int64) - base).astype(np.uint64)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        packed = []
        for i in range(0, n, CELLS):  # a multiple of 8 values fills whole bytes
            bits = ((v[i : i + CELLS, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
            packed.append(np.packbits(bits, bitorder="little"))
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        upper = np.zeros((int(at[-1]) + 1 if n else 0), np.uint8)
        upper[at] = 1
        return cls(n, low_bits, base, np.concatenate([np.zeros(0, np.uint8), *packed]), np.packbits(upper, bitorder="little"), at[::STEP].astype("<u4"))

    def to_bytes(self) -> bytes:
        return HEAD.pack(b"EFS1", self.low_bits, self.n, self.base & (2**64 - 1), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.directory.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple["EliasFano", int]:
        """The sequence stored at that place, and where it ends."""
        magic, low_bits, n, base, size = HEAD.unpack_from(data, at)
        if magic != b"EFS1":
            raise ValueError("no Elias-Fano sequence here")
        at += HEAD.size
        parts = []
        for kind, count in ((np.uint8, -(-n * low_bits // 8)), (np.uint8, size), ("<u4", -(-n // STEP))):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, low_bits, base - (1 << 64) if base >> 63 else base, *parts), at

    def lows(self, first: int, count: int) -> np.ndarray:
        bits = np.unpackbits(self.low[first * self.low_bits // 8 : -(-(first + count) * self.low_bits // 8)], bitorder="little")
        skip = first * self.low_bits % 8
        cells = bits[skip : skip + count * self.low_bits].reshape(count, self.low_bits).astype(np.int64)
        return cells @ (1 << np.arange(self.low_bits, dtype=np.int64)) if self.low_bits else np.zeros(count, np.int64)

    def select(self, first: int, count: int = 1) -> np.ndarray:
        """The values from the first-th on, so many: only the bits between the directory's entries around them are looked at."""
        if count < 0 or not 0 <= first <= first + count <= self.n:
            raise IndexError((first, count))
        if not count:
            return np.zeros(0, np.int64)
        block, skip = divmod(first, STEP)
        after = (first + count - 1) // STEP + 1
        start = int(self.directory[block])
        end = int(self.directory[after]) + 1 if after < len(self.directory) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start // 8 : -(-end // 8)], bitorder="little")[start % 8 :]
        at = start + np.flatnonzero(bits)[skip : skip + count]
        return self.base + ((at - np.arange(first, first + count)) << self.low_bits) + self.lows(first, count)

    def values(self) -> np.ndarray:
        return self.select(0, self.n)

    @property
    def nbytes(self) -> int:
        return HEAD.size + self.low.nbytes + self.high.nbytes + self.directory.nbytes
