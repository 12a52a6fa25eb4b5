"""Vectorised text primitives over the UTF-8 bytes of Arrow string columns.

All functions work on a block: the bytes of some consecutive rows as they lie in
Arrow's buffer, with the rows' offsets.  Nothing is done row by row in Python, and
memory is bounded by the block size (a single longer text is a block of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in a block; scratch arrays take a few times eight bytes for each.
BLOCK_BYTES = 1 << 20
#: Rows of a block at most, so that two bytes number them.
BLOCK_ROWS = 1 << 15

_U = np.uint64
#: Multiplier of the polynomial hash modulo 2**64 and its inverse.
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def _whitespace() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


WHITESPACE, LOWERED = _whitespace(), _lowered()
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit words (the public splitmix64 steps)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of blocks of at most ``most`` bytes, or one row, and ``BLOCK_ROWS`` rows."""
    data, at = text_buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1), i + BLOCK_ROWS)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITESPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without separators, and for each row the index of its first run."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    gap = separators[data]
    solid = ~gap
    before = np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    after = np.empty_like(gap)
    after[-1], after[:-1] = True, gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers: dict[int, np.ndarray] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64, by doubling; kept for the next block."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        filled = 1
        with np.errstate(over="ignore"):
            while filled < size:
                have[filled : 2 * filled] = have[:filled] * _U(pow(base, filled, 1 << 64))
                filled *= 2
        _powers[base] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes: prefix sums of a polynomial, so the cost
    does not depend on how spans lie.  Equal spans of any blocks hash alike."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * _geometric(_P, len(data)), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _geometric(_P_INVERSE, len(data))[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a row and the row bounds among
    them.  A row with fewer words, but some, gives one hash of its whole sequence."""
    counts = np.diff(first)
    given = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(given)))
    row = np.repeat(np.arange(len(counts)), given)
    at = first[:-1][row] + (np.arange(bounds[-1]) - bounds[:-1][row])
    length = np.minimum(counts, width)[row]
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            inside = k < length
            h[inside] = mix(h[inside] * _U(_P) + words[at[inside] + k] + _U(k + 1))
    return h, bounds


def code_point_starts(data: np.ndarray) -> np.ndarray:
    """Running count of code points: entry i is the number that begin before byte i."""
    counts = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=counts[1:])
    return counts
