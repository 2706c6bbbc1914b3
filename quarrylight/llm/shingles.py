"""Word shingles of many texts at once, as 64-bit hashes worked out from the UTF-8 bytes in numpy.

Words are runs of bytes other than U+0020 and U+0009 to U+000D; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one numpy pass takes at most, unless a single text is longer.
CHUNK_BYTES = 1 << 20
_RNG = np.random.default_rng(20240131)
#: A value for each byte, and the same with A-Z as a-z.
RAW_BYTE = _RNG.integers(1, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BYTE = RAW_BYTE.copy()
BYTE[65:91] = BYTE[97:123]
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_AHEAD, _BEHIND = powers(STEP, 1), powers(BACK, 1)


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse, ``n`` at least; kept by the worker."""
    global _AHEAD, _BEHIND
    if len(_AHEAD) < n:
        _AHEAD, _BEHIND = powers(STEP, max(n, CHUNK_BYTES)), powers(BACK, max(n, CHUNK_BYTES))
    return _AHEAD, _BEHIND


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in ``data``, and the number of the first word of each text.

    ``starts`` has where each text begins, and the end of the last one.
    """
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = starts[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    ends[before] = inside[before]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    ahead, behind = tables(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * ahead[: len(data)], dtype=np.uint64)])
    words = mix((sums[last + 1] - sums[first]) * behind[first])
    return words, np.searchsorted(first, starts)


def joined(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` words in a row."""
    size = len(words) - n + 1
    h = words[:size].copy()
    for k in range(1, n):
        h = mix(h) + words[k : k + size]
    return mix(h)


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, starts) in runs of bounded size, straight from the column's buffers; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct ``n``-word shingles, ascending; with fewer words the whole sequence is one."""
    for _, data, starts in text_slices(column):
        words, at = word_hashes(data, starts)
        grams = joined(words, n) if len(words) >= n else words[:0]
        for a, b in zip(at, at[1:], strict=False):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield joined(words[a:b], int(b - a)) + np.uint64(b - a)
            else:
                yield words[:0]
