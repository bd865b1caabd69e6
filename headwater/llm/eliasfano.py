"""Elias-Fano sequences over one flat buffer, read through a memory map.

A non-decreasing sequence of n numbers below u is stored as its low bits (about log2(u/n) each, packed)
and its high parts in unary, one bit for each number and one for each step: some 2 + log2(u/n) bits a
number. A count of ones for each 64-bit word of the unary part makes select a search among words and then
within one word. All readings are of many positions at once.
"""

from __future__ import annotations

import mmap

import numpy as np

_U = np.uint64


def pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, one after the other, in 64-bit words (one spare)."""
    out = np.zeros((len(values) * width + 63) // 64 + 1, np.uint64)
    if width and len(values):
        low = values & _U((1 << width) - 1) if width < 64 else values
        at = np.arange(len(values), dtype=np.uint64) * _U(width)
        word, shift = at >> _U(6), at & _U(63)
        np.bitwise_or.at(out, word, low << shift)
        spill = (shift > 0) & (shift + _U(width) > 64)
        np.bitwise_or.at(out, word[spill] + _U(1), low[spill] >> (_U(64) - shift[spill]))
    return out


def read_low(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.uint64) * _U(width)
    word, shift = (bit >> _U(6)).astype(np.int64), bit & _U(63)
    out = words[word] >> shift
    up = np.where(shift > 0, words[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
    out = out | up
    return out & _U((1 << width) - 1) if width < 64 else out


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one with the given rank (from 0) in each word."""
    place, rest = np.zeros(len(words), np.uint64), rank.astype(np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count((words >> place) & _U((1 << step) - 1)).astype(np.int64)
        over = rest >= ones
        rest = np.where(over, rest - ones, rest)
        place = np.where(over, place + _U(step), place)
    return place.astype(np.int64)


class EliasFano:
    """``parts`` are the arrays that a buffer holds; see ``encode`` and ``sections``."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        # zeros before each word; derived, not stored
        self._zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        parts = (values >> _U(width)) + np.arange(n, dtype=np.uint64)
        size = int(parts[-1]) + 2 if n else 1
        high = np.zeros(size // 64 + 2, np.uint64)
        np.bitwise_or.at(high, parts >> _U(6), _U(1) << (parts & _U(63)))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]]).astype(np.uint32 if n < 2**32 else np.uint64)
        return cls(n, width, pack_low(values, width), high, ones)

    def sections(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.uint64), self.low, self.high, self.ones]

    @classmethod
    def of_sections(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])

    def _select(self, before: np.ndarray, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        word = np.searchsorted(before, rank, side="right") - 1
        return word * 64 + _select_in_word(words[word], rank - before[word].astype(np.int64))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, np.int64)
        if not len(at):
            return np.zeros(0, np.uint64)
        part = self._select(self.ones, self.high, at) - at
        return (part.astype(np.uint64) << _U(self.width)) | read_low(self.low, self.width, at)

    def next_at_least(self, values: np.ndarray) -> np.ndarray:
        """For each value the first position that holds it or more; n if there is none."""
        values = values.astype(np.uint64)
        if not self.n or not len(values):
            return np.zeros(len(values), np.int64)
        last = (int(self[np.array([self.n - 1])][0])) >> self.width
        part = np.minimum(values >> _U(self.width), _U(last + 1)).astype(np.int64)
        beyond = part > last
        part = np.where(beyond, last, part)
        # numbers with a smaller high part lie before the zero that ends the part before this one
        first = np.where(part > 0, self._select_zero(np.maximum(part - 1, 0)) - np.maximum(part - 1, 0), 0)
        end = np.minimum(self._select_zero(part) - part, self.n)
        want = read_value_low(values, self.width)
        lo, hi = first.copy(), end.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = read_low(self.low, self.width, mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return np.where(beyond, self.n, lo)

    def _select_zero(self, rank: np.ndarray) -> np.ndarray:
        return self._select(self._zeros, ~self.high, rank)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, or -1."""
        at = self.next_at_least(values)
        inside = at < self.n
        out = np.full(len(values), -1, np.int64)
        hit = np.flatnonzero(inside)
        same = self[at[hit]] == values[hit].astype(np.uint64)
        out[hit[same]] = at[hit[same]]
        return out


def read_value_low(values: np.ndarray, width: int) -> np.ndarray:
    return values & _U((1 << width) - 1) if width < 64 else values


def to_buffer(arrays: list[np.ndarray]) -> bytes:
    """A directory (kind, length) and then the arrays, each from a multiple of 8 bytes."""
    kinds = {"u8": 0, "u4": 1, "u1": 2}
    head = [np.array([len(arrays)], np.uint64)]
    body = []
    for a in arrays:
        head.append(np.array([kinds[a.dtype.str[1:]], len(a)], np.uint64))
        raw = a.tobytes()
        body.append(raw + b"\0" * (-len(raw) % 8))
    return b"".join([*(h.tobytes() for h in head), *body])


def from_buffer(data: bytes) -> list[np.ndarray]:
    """The arrays as views of a memory map that holds the buffer.

    The map is anonymous: levels come as rows of a table, and a cluster's machines share no local files.
    """
    held = mmap.mmap(-1, max(len(data), 1))
    held.write(data)
    count = int(np.frombuffer(held, np.uint64, 1)[0])
    head = np.frombuffer(held, np.uint64, 2 * count, 8).reshape(-1, 2)
    at, out = 8 + 16 * count, []
    for kind, length in head.tolist():
        dtype = np.dtype(("u8", "u4", "u1")[kind])
        out.append(np.frombuffer(held, dtype, length, at))
        at += -(-length * dtype.itemsize // 8) * 8
    return out
