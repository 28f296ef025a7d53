"""Sets of hashed word shingles of whole texts."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .texts import slices
from .words import LOWER, hashes, mix, spans

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each slice of rows: all rows' distinct shingle hashes, ascending within a row, and the n + 1 offsets of the rows.

    A row with fewer words than ``size`` has its whole sequence as one shingle; a row without words has none.
    """
    factors = FACTORS[:size]
    for _, _, data, offsets in slices(column):
        low = LOWER[data]
        starts, ends, upto = spans(low, offsets)
        words = hashes(low, starts, ends)
        count = np.diff(upto)
        rolled = np.zeros(len(words), np.uint64)
        for j, f in enumerate(factors):
            rolled[: max(len(words) - j, 0)] += words[j:] * f
        rows = np.repeat(np.arange(len(count)), count)
        full = np.arange(len(words)) + size <= upto[1:][rows]
        for r in np.flatnonzero((count > 0) & (count < size)):
            rolled[upto[r]] = np.sum(words[upto[r] : upto[r + 1]] * factors[: count[r]], dtype=np.uint64) + np.uint64(count[r])
            full[upto[r]] = True
        found, rows = mix(rolled[full]), rows[full]
        order = np.lexsort((found, rows))
        found, rows = found[order], rows[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
        yield found[new], np.searchsorted(rows[new], np.arange(len(count) + 1))


def row_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The distinct shingle hashes of each row."""
    return [found[a:b] for found, offsets in shingle_sets(column, size) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
