"""Hashes of words and of their n-grams, for many texts at once.

Words are runs of anything but ASCII white space, ASCII letters in lower case.
A word's hash is a polynomial of its bytes' codes, modulo 2**64, and then
mixed; sums over the bytes of a whole batch give all of its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes whose words are hashed in one go, and so the longest word that is hashed as a polynomial.
PIECE = 1 << 18

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_CODES = np.where(_WHITE, np.uint64(0), mixed((_LOWER + np.uint64(1)) * _M1) | np.uint64(1))


def _powers(base: int) -> np.ndarray:
    steps = np.full(2 * PIECE + 1, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_tables: list[np.ndarray] = []


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of text as bytes, and where each text begins and ends; null is empty."""
    column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    at = np.frombuffer(at, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8), at - at[0]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and where each text's words begin and end."""
    if not _tables:
        _tables.extend((_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))))
    power, inverse = _tables
    white = _WHITE[data]
    begins = ~white
    begins[1:] &= white[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    begins[heads] = ~white[heads]
    starts = np.flatnonzero(begins)
    out = np.empty(len(starts), np.uint64)
    ends = np.append(starts[1:], len(data))
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        piece = data[lo : ends[j - 1]]
        if len(piece) > PIECE:  # one word, and what follows it
            word = piece.tobytes().rstrip()
            if len(word) > PIECE:
                out[i] = xxhash.xxh64_intdigest(word.lower())
                i = j
                continue
            piece = piece[: len(word)]
        sums = np.add.reduceat(_CODES[piece] * power[: len(piece)], starts[i:j] - lo)
        out[i:j] = mixed(sums * inverse[starts[i:j] - lo])
        i = j
    return out, np.searchsorted(starts, bounds)


def sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct n-grams of words.

    Fewer than n words are one n-gram; without words there is none.
    """
    h, at = word_hashes(*flat(column))
    grams = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for i in range(n):
        grams = grams * _M1 + h[i : i + len(grams)]
    grams = mixed(grams)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= n:
            own = np.sort(grams[lo : hi - n + 1])
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            yield own[fresh]
        elif hi > lo:
            one = np.full(1, hi - lo, np.uint64)
            for i in range(lo, hi):
                one = one * _M1 + h[i : i + 1]
            yield mixed(one)
        else:
            yield np.empty(0, np.uint64)
