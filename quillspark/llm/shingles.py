"""Distinct word-shingle sets of whole texts as sorted 64-bit digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillspark.llm.common import mix, slices, word_hashes


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per slice: its first row, the concatenated sorted sets, and their offsets (rows + 1)."""
    for start, end, data, offsets in slices(column):
        words, first = word_hashes(data, offsets)
        counts = np.diff(first)
        rows = np.arange(end - start)
        sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        base = np.repeat(first[:-1], sizes) + ragged(sizes)
        owner = np.repeat(rows, sizes)
        length = np.minimum(counts, width)[owner]
        digest = np.full(len(base), 0x51ED270B7F4A7C15, dtype=np.uint64)
        for k in range(width):
            live = k < length
            value = words[np.minimum(base + k, max(len(words) - 1, 0))] if len(words) else digest
            digest = np.where(live, mix(digest ^ value) + np.uint64(k + 1), digest)
        ends = np.cumsum(sizes)
        for a, b in zip((ends - sizes).tolist(), ends.tolist()):
            if b - a > 1:
                digest[a:b].sort()
        fresh = np.ones(len(digest), dtype=bool)
        fresh[1:] = (digest[1:] != digest[:-1]) | (owner[1:] != owner[:-1])
        digest, owner = digest[fresh], owner[fresh]
        yield start, digest, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=end - start))])


def ragged(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. size-1 for each size, in one array."""
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    return np.arange(total) - np.repeat(begin, sizes)


def segments(values: np.ndarray, offsets: np.ndarray, reduce, empty) -> np.ndarray:
    """``reduce`` (a ufunc) over each segment; ``empty`` where it has none."""
    sizes = np.diff(offsets)
    out = np.full(len(sizes), empty, dtype=values.dtype)
    full = sizes > 0
    if full.any():
        out[full] = reduce.reduceat(values, offsets[:-1][full])
    return out
