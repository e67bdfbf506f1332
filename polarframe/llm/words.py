"""Words of whole Arrow columns as 64-bit hashes, without a Python step per word.

A word hash is a polynomial over the word's bytes modulo 2^64, mixed with its length. Two words of one text or
of two compared texts collide with a chance of about 2^-64 per pair, so set sizes and overlaps computed from
hashes are exact for all practical purposes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLOCK = 1 << 12
_powers: dict[np.uint64, np.ndarray] = {}
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


class Words(NamedTuple):
    """Words of a batch in order; ``first[d] : first[d + 1]`` are those of text ``d``."""

    hash: np.ndarray
    start: np.ndarray  # byte offsets inside the word's own text
    end: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, _BLOCK), base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p)
    return _powers[base][:n]


def _blocks(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``x`` and ``y`` so that ``base`` ** i is y[i // _BLOCK] * x[i % _BLOCK] for all i below ``n``: no table as long as the texts."""
    return _power(base, _BLOCK), _power(np.uint64(pow(int(base), _BLOCK, 1 << 64)), -(-n // _BLOCK))


def words(column: pa.Array, lower: bool = False) -> Words:
    """Maximal runs of bytes that are not white space; a null text has none. ``lower`` folds A-Z only."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count:
        column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    n = high - low
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(column) + 1, np.int64))
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[low:high]
    offsets = offsets - low
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~SPACE[data]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < n)]
    fresh[borders] = inside[borders]
    start = np.flatnonzero(fresh)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[borders - 1] = inside[borders - 1]
    end = np.flatnonzero(last) + 1
    # Eight bytes for every byte of text, so it is worked on in place.
    sums = np.zeros(-(-n // _BLOCK) * _BLOCK + 1, np.uint64)
    sums[1 : n + 1] = data
    sums[1 : n + 1] += np.uint64(1)
    x, y = _blocks(_BASE, n)
    each = sums[1:].reshape(-1, _BLOCK)
    each *= x
    each *= y[:, None]
    np.cumsum(sums, out=sums)
    x, y = _blocks(_INVERSE, n)
    value = (sums[end] - sums[start]) * (y[start // _BLOCK] * x[start % _BLOCK])
    value = mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    first = np.searchsorted(start, offsets, "left")
    own = np.repeat(offsets[:-1], np.diff(first))
    return Words(value, start - own, end - own, first)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words in order; of the whole sequence if it is shorter, none if empty."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(width, n)
    total = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[i : n - size + 1 + i]
    return mix(total)
