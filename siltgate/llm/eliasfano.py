"""Elias-Fano sequences: non-decreasing integers in near-minimal space, with select."""

from __future__ import annotations

import struct

import numpy as np

#: Every so many ones of the upper bits, their place is kept (32 bits each).
EVERY = 256
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_HEAD = struct.Struct("<QQBxxxIII")


def encode(values: np.ndarray) -> bytes:
    """Low bits packed, high parts in unary, and the places of every EVERY-th one."""
    v = np.asarray(values, np.uint64)
    n, top = len(v), int(v[-1]) if len(v) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    if n:
        upper = np.zeros((top >> low) + n + 1, np.uint8)
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        upper[ones] = 1
        high = np.packbits(upper, bitorder="little").tobytes()
        places = (ones[::EVERY]).astype("<u4").tobytes()
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        lower = np.packbits(bits.ravel(), bitorder="little").tobytes()
    else:
        high = places = lower = b""
    return _HEAD.pack(n, top, low, len(lower), len(high), len(places)) + lower + high + places


class Reader:
    """Random and bulk access to an encoded sequence."""

    def __init__(self, data: bytes | memoryview, at: int = 0) -> None:
        self.n, self.top, self.low, nl, nh, np_ = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        raw = np.frombuffer(data, np.uint8, nl + nh + np_, at)
        self.lower, self.high, self.places = raw[:nl], raw[nl : nl + nh], raw[nl + nh :].view("<u4") if np_ else np.zeros(0, np.uint32)
        self.end = at + nl + nh + np_

    def _low(self, i: int) -> int:
        at, value = i * self.low, 0
        for j in range(self.low):
            value |= int(self.lower[(at + j) >> 3] >> ((at + j) & 7) & 1) << j
        return value

    def select(self, i: int) -> int:
        """The i-th value, from the nearest kept place by counting ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.places[i // EVERY]), i % EVERY
        byte = place >> 3
        left += int(_ONES[self.high[byte] & ((1 << (place & 7)) - 1)])
        while True:
            here = int(_ONES[self.high[byte]])
            if left < here:
                break
            left -= here
            byte += 1
        bits, bit = int(self.high[byte]), -1
        for _ in range(left + 1):
            bit += 1
            while not bits >> bit & 1:
                bit += 1
        return ((byte * 8 + bit - i) << self.low) | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        value = (ones - np.arange(self.n)) << self.low
        if self.low:
            bits = np.unpackbits(self.lower, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
            value = value | (bits.astype(np.int64) << np.arange(self.low)).sum(1)
        return value
