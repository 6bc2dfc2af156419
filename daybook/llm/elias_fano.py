"""Monotone sequences in Elias-Fano form, over memory-mapped levels."""

from __future__ import annotations

import os
import tempfile

import numpy as np


class Levels:
    """Arrays kept in one memory-mapped file of the task, gone when it is closed."""

    def __init__(self):
        self.file = tempfile.TemporaryFile(prefix="levels-")
        self.size = 0

    def map(self, values: np.ndarray) -> np.ndarray:
        if not len(values):
            return values
        start = -(-self.size // 64) * 64
        self.file.seek(start)
        self.file.write(np.ascontiguousarray(values).data)
        self.file.flush()
        self.size = start + values.nbytes
        return np.memmap(self.file, values.dtype, "r", start, values.shape)

    def close(self) -> None:
        self.file.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


class EliasFano:
    """A sorted sequence below ``universe``: the low bits of every number packed, the
    high ones as a bit vector with a one for each number and a zero after each value
    of the high bits."""

    def __init__(self, values: np.ndarray, universe: int, levels: Levels):
        values = values.astype(np.uint64)
        self.n = n = len(values)
        self.low_bits = low = max(0, (universe // max(n, 1)).bit_length() - 1)
        self.last_high = max(universe - 1, 0) >> low
        high = (values >> np.uint64(low)).astype(np.int64)
        bits = np.zeros(-(-(n + self.last_high + 1) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = 64 - np.bitwise_count(words).astype(np.int64)
        self.words = levels.map(words)
        # Zeros before each word: the directory of select.
        self.zeros = levels.map(np.r_[0, np.cumsum(zeros)[:-1]])
        packed = np.zeros(0, np.uint8)
        if low:
            shifts = np.arange(low, dtype=np.uint64)
            # Some numbers at a time, a multiple of eight: their bits fill whole bytes.
            packed = np.concatenate([packed, *(
                np.packbits(((values[i : i + (1 << 14), None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
                for i in range(0, n, 1 << 14)
            )])
        self.packed = levels.map(np.r_[packed, np.zeros(9, np.uint8)])

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        first = bit >> 3
        got = np.zeros(len(at), np.uint64)
        for k in range((self.low_bits + 14) // 8):
            if k < 8:
                got |= self.packed[first + k].astype(np.uint64) << np.uint64(8 * k)
        shift = (bit & 7).astype(np.uint64)
        return (got >> shift) & np.uint64((1 << self.low_bits) - 1)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the zero with ``k`` zeros before it."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        rest = k - self.zeros[word]
        bits = ~self.words[word]
        place = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = (bits >> place.astype(np.uint64)) & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(part).astype(np.int64)
            skip = ones <= rest
            rest = np.where(skip, rest - ones, rest)
            place = np.where(skip, place + width, place)
        return word * 64 + place

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first number not below each value (``n`` if none), and whether
        it is that value."""
        if not self.n:
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        # Numbers with these high bits lie between two zeros.
        start = np.where(high > 0, self._select0(np.maximum(high, 1) - 1) + 1 - high, 0)
        stop = end = self._select0(high) - high
        while (open_ := start < stop).any():
            middle = (start + stop) // 2
            less = open_ & (self._low(np.minimum(middle, self.n - 1)) < low)
            start = np.where(less, middle + 1, start)
            stop = np.where(open_ & ~less, middle, stop)
        hit = (start < end) & (self._low(np.minimum(start, self.n - 1)) == low)
        return start, hit

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """Numbers by place."""
        word_ones = np.arange(len(self.words)) * 64 - self.zeros  # ones before each word
        word = np.searchsorted(word_ones, at, "right") - 1
        rest = at - word_ones[word]
        bits = np.asarray(self.words[word])
        place = np.zeros(len(at), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = (bits >> place.astype(np.uint64)) & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(part).astype(np.int64)
            skip = ones <= rest
            rest = np.where(skip, rest - ones, rest)
            place = np.where(skip, place + width, place)
        high = (word * 64 + place - at).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(at)


def file_bytes(levels: Levels) -> int:
    return os.fstat(levels.file.fileno()).st_size
