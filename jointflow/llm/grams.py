"""Byte grams of texts as numbers, and look-ups of many of them at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

END = b"\xff"  # never a byte of UTF-8


def chunks(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    """The texts in order, in lists of about ``size`` bytes (one text at least)."""
    chunk, held = [], 0
    for t in texts:
        chunk.append(t)
        held += len(t)
        if held >= size:
            yield chunk
            chunk, held = [], 0
    if chunk:
        yield chunk


def byte_grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for every byte of each text and its end: ``depth`` bytes of context, then the byte.

    Zeros stand before a text. Also returns where each text's grams end.
    """
    pad = bytes(depth)
    data = np.frombuffer(b"".join([pad + t + END for t in texts]), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    n = len(data)
    grams = np.zeros(n, np.int64)
    for k in range(depth, -1, -1):
        grams[depth:] <<= 8
        grams[depth:] |= data[depth - k : n - k]
    real = np.ones(n, bool)
    starts = np.cumsum(size + depth) - size - depth
    for k in range(depth):
        real[starts + k] = False
    return grams[real], np.cumsum(size)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values of each text; every text has one value at least."""
    return np.add.reduceat(values, np.concatenate([[0], ends[:-1]]))


class Lookup:
    """Places of numbers among sorted distinct ``keys``: -1 for others. One probe of a hash table; the few keys
    that lost their slot to another are searched for."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys.astype(np.int64)
        bits = max(8, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.full(1 << bits, -1, np.int32)
        slots = self._slots(self.keys)
        self.table[slots] = np.arange(len(keys), dtype=np.int32)
        lost = np.flatnonzero(self.table[slots] != np.arange(len(keys)))
        self.lost_at, self.lost = lost, self.keys[lost]

    def _slots(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(numbers), -1, np.int64)
        at = self.table[self._slots(numbers)].astype(np.int64)
        wrong = np.flatnonzero(self.keys[at] != numbers)
        if len(wrong):
            found = np.full(len(wrong), -1, np.int64)
            if len(self.lost):
                asked = numbers[wrong]
                place = np.minimum(np.searchsorted(self.lost, asked), len(self.lost) - 1)
                found = np.where(self.lost[place] == asked, self.lost_at[place], -1)
            at[wrong] = found
        return at
