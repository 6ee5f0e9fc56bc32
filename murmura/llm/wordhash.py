"""Hashes of words and of word shingles for whole Arrow batches, without a Python object per word.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z count as a-z.
Every function takes texts as one byte array with offsets, so the cost is a
few array passes per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
#: Texts are worked off in slices of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 1 << 21
_POWERS = 1 << 16

_random = np.random.Generator(np.random.PCG64(20240229))
_odd = lambda n: _random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# What a byte adds to the hash of its word; white space adds nothing.
_BYTE = _odd(256)[LOWER]
_BYTE[_SPACE] = 0
_BASE, _BASE_HIGH, _LENGTH, *_TURNS = (int(x) for x in _odd(3 + WIDTH))
_MASK = (1 << 64) - 1


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate(
            [np.ones(1, np.uint64), np.cumprod(np.full(_POWERS - 1, base, np.uint64))]
        )


_POWER, _POWER_HIGH = _powers(_BASE), _powers(pow(_BASE, _POWERS, _MASK + 1))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (splitmix64's finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of about ``SLICE_BYTES`` each; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash of each word, start byte of each word, first word of each text)``.

    The last array has one entry more than there are texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, first
    lengths = np.diff(starts, append=n)
    place = np.arange(starts[0], n) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        terms = _BYTE[data[starts[0] :]]
        terms *= _POWER[place & (_POWERS - 1)]
        if (high := int(place.max()) // _POWERS):
            if high >= _POWERS:
                raise ValueError("a word of over 4 GB")
            terms *= _POWER_HIGH[place // _POWERS]
        hashes = np.add.reduceat(terms, starts - starts[0])
        hashes += np.add.reduceat(inside[starts[0] :], starts - starts[0], dtype=np.uint64) * np.uint64(_LENGTH)
    return mixed(hashes), starts, first


def shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of each run of ``width`` words of one text; of the whole text where it has fewer words."""
    if not len(hashes):
        return hashes
    n = max(len(hashes) - width + 1, 1)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(min(len(hashes), width)))
        for turn in range(min(width, len(hashes))):
            total += hashes[turn : turn + n] * np.uint64(_TURNS[turn])
    return mixed(total)
