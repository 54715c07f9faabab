"""Hashes of all words and n-grams of a text by array operations."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
#: Odd, so it has an inverse modulo 2^64.
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256).astype(np.uint64)
#: Random numbers of a rolling hash, one for each byte.
GEAR = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 32, 256, dtype=np.uint32)
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def row_of_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse for i < n."""
    out = []
    for b in (BASE, BASE_INVERSE):
        row = np.full(n, b, np.uint64)
        row[:1] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


POWERS = row_of_powers(1 << 14)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (POWERS[0][:n], POWERS[1][:n]) if n <= len(POWERS[0]) else row_of_powers(n)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return (h ^ (h >> np.uint64(29))) * BASE


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return edges[::2], edges[1::2]


class Prefixes:
    """Hashes of any piece of a text in constant time, from running sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * up[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive elements."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * BASE + h[k : len(h) - n + 1 + k]
    return mixed(out)


#: Bytes or characters of a text that are hashed at once.
PIECE = 1 << 20


def word_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Some words after the other with their prefix sums: (first, last, shift, Prefixes); so a long text never needs sums of its own length."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
        yield i, j, starts[i], Prefixes(data[starts[i] : ends[j - 1]])
        i = j


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    for i, j, at, prefixes in word_pieces(data, starts, ends):
        out[i:j] = prefixes.of(starts[i:j] - at, ends[i:j] - at)
    return out


def code_points(raw: bytes, text: str) -> np.ndarray:
    return np.frombuffer(raw, np.uint8) if len(raw) == len(text) else np.frombuffer(text.encode("utf-32-le"), np.uint32)


def char_grams(points: np.ndarray, n: int):
    """Hashes of all runs of n characters, a piece after the other."""
    for first in range(0, len(points) - n + 1, PIECE):
        yield windows(points[first : first + PIECE + n - 1].astype(np.uint64) + np.uint64(1), n)


_ONES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash fingerprints of rows of hashes, of which the first ``sizes`` count and the others are zero: a bit is set if it is in over half of them.

    A byte's lane counts one bit of up to 255 hashes at once.
    """
    f, n = hashes.shape
    counts = np.zeros((f, 8, 8), np.int64)  # row, bit in byte, byte
    step = 255 * 64
    for i in range(0, n, step):
        part = hashes[:, i : i + step]
        blocks = -(-part.shape[1] // 255)
        if part.shape[1] % 255:
            part = np.concatenate([part, np.zeros((f, blocks * 255 - part.shape[1]), np.uint64)], axis=1)
        part = part.reshape(f, blocks, 255)
        for bit in range(8):
            lanes = ((part >> np.uint64(bit)) & _ONES).sum(axis=2, dtype=np.uint64)
            counts[:, bit] += np.ascontiguousarray(lanes).view(np.uint8).reshape(f, blocks, 8).sum(axis=1, dtype=np.int64)
    bits = 2 * counts > np.asarray(sizes).reshape(f, 1, 1)
    return np.packbits(bits.transpose(0, 2, 1).reshape(f, 64), axis=1, bitorder="little").view("<u8").reshape(f)
