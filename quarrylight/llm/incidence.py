"""Sparse incidence matrices in compressed sparse rows, with Gustavson's product row by row, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Terms that one pass of a product lays out, unless a single row has more.
TERMS_PER_PASS = 500_000


class Csr(NamedTuple):
    """Row i has the columns ``cols[starts[i]:starts[i + 1]]``, ascending and distinct, with their ``values``."""

    starts: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    width: int

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def offsets(sizes: np.ndarray) -> np.ndarray:
    """Where each of several runs of these sizes starts, and where the last ends."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, end to end."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def merged(keys: np.ndarray, values: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their values (with their number of places, if values is None)."""
    if values is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[order], first) if len(keys) else values[:0]


def from_entries(rows: np.ndarray, cols: np.ndarray, height: int, width: int) -> Csr:
    """The matrix that counts how often each (row, column) is named."""
    keys, counts = merged(rows.astype(np.int64) * width + cols, None)
    return Csr(np.searchsorted(keys, np.arange(height + 1, dtype=np.int64) * width), keys % width, counts, width)


def incidence(lengths: np.ndarray) -> Csr:
    """Row i covers the next ``lengths[i]`` columns: tokens by bytes."""
    starts = offsets(lengths)
    return Csr(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64), int(starts[-1]))


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.cols, kind="stable")
    return Csr(np.searchsorted(m.cols[order], np.arange(m.width + 1)), m.rows()[order], m.values[order], len(m.starts) - 1)


def product(left: Csr, right: Csr) -> Csr:
    """Gustavson's product: each entry (i, k) of ``left`` adds its multiple of row k of ``right`` to row i.

    Rows are taken as many at a time as have TERMS_PER_PASS terms together; a row's terms of one column are summed.
    """
    sizes = np.diff(right.starts)[left.cols]
    terms = offsets(sizes)[left.starts]
    height, first, sizes_out, cols, values = len(left.starts) - 1, 0, [], [], []
    while first < height:
        end = min(max(int(np.searchsorted(terms, terms[first] + TERMS_PER_PASS, side="right")) - 1, first + 1), height)
        own = slice(left.starts[first], left.starts[end])
        row = np.repeat(np.arange(end - first), terms[first + 1 : end + 1] - terms[first:end])
        at = right.starts[left.cols[own]]
        keys, sums = merged(row * right.width + runs(right.cols, at, sizes[own]), runs(right.values, at, sizes[own]) * np.repeat(left.values[own], sizes[own]))
        sizes_out.append(np.bincount(keys // right.width, minlength=end - first))
        cols.append(keys % right.width)
        values.append(sums)
        first = end
    empty = [np.zeros(0, np.int64)]
    return Csr(offsets(np.concatenate(sizes_out or empty)), np.concatenate(cols or empty), np.concatenate(values or empty), right.width)


def row_sums(m: Csr, by_column: np.ndarray | None = None) -> np.ndarray:
    """The sum of each row's values, each times its column's entry of ``by_column`` if given."""
    sums = offsets(m.values if by_column is None else m.values * by_column[m.cols])
    return sums[m.starts[1:]] - sums[m.starts[:-1]]
