"""Content-defined chunks of byte texts by a gear rolling hash."""

from __future__ import annotations

import numpy as np

from quillspark.llm.common import mix

GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """``h[i] = (h[i-1] << 1) + GEAR[byte i]`` in 32 bits, which is a sum over the last 32 bytes.

    The sum over 2, 4, .. 32 bytes is built by doubling, so no loop runs over bytes.
    """
    total = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        total[shift:] = total[shift:] + (total[:-shift] << np.uint32(shift))
    return total


def chunk_ends(data: np.ndarray, offsets: np.ndarray, bits: int, least: int, most: int) -> np.ndarray:
    """Ends of all chunks of all rows of a slice; every row starts anew and ends with a chunk.

    A chunk ends where the top ``bits`` of the hash are 0, at ``least`` bytes or more, before a byte that
    starts a character. Where that leaves more than ``most`` bytes, it ends at the least hash within them,
    so that even periodic text, which may never hit, is cut by its content.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    opens = np.ones(len(data) + 1, dtype=bool)
    opens[:-1] = (data & 0xC0) != 0x80
    hashes = gear_hashes(data)
    cuts = np.flatnonzero((hashes >> np.uint32(32 - bits)) == 0) + 1
    cuts = cuts[opens[cuts]]
    points = cuts.tolist()
    bounds = np.searchsorted(cuts, offsets, side="right").tolist()
    ends: list[int] = []

    def forced(at: int) -> int:
        window = np.where(opens[at + least : at + most + 1], hashes[at + least - 1 : at + most], np.uint32(0xFFFFFFFF))
        return at + least + int(window.argmin())

    for row, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        at = start
        for cut in [*points[bounds[row] : bounds[row + 1]], stop]:
            while cut - at > most:
                at = forced(at)
                ends.append(at)
            if cut - at >= least and cut < stop:
                ends.append(cut)
                at = cut
        if at < stop:
            ends.append(stop)
    return np.array(ends, dtype=np.int64)
