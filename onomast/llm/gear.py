"""Content-defined cuts by a rolling gear hash, over whole arrays of bytes.

Every byte shifts the hash by one bit and adds its gear, so a hash of w bits knows the last w bytes
and no others. A cut follows a byte whose hash starts with `bits` zeros, unless such a byte came
within the `least` - 1 bytes before it; a stretch of more than `most` bytes is cut every `most`
bytes. All three rules look at nearby bytes only: an insertion moves no cut far from it.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: 256 gears and one for the padding between texts, which adds nothing.
GEARS = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8, person=b"gear").digest(), "little") for b in range(256)], np.uint64)


def rolling(data: np.ndarray, dtype=np.uint32) -> np.ndarray:
    """The hash after each byte of data; its width is the window in bytes."""
    h = GEARS.astype(dtype)[data]
    width, step = np.dtype(dtype).itemsize * 8, 1
    while step < width:  # h covers `step` bytes; twice as many after each turn
        older = h[:-step] << dtype(step)
        h[step:] += older
        step *= 2
    return h


def cuts(data: np.ndarray, bits: int, least: int, most: int, dtype=np.uint32) -> np.ndarray:
    """Ends of the chunks of data, its own end included."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    width = np.dtype(dtype).itemsize * 8
    at = np.flatnonzero(rolling(data, dtype) < dtype(1 << (width - bits))) + 1
    at = at[(at >= least) & (at < n)]
    if len(at):
        at = at[np.concatenate([[True], np.diff(at) >= least])]
    ends = np.append(at, n)
    gaps = np.diff(np.concatenate([[0], ends]))
    if (gaps > most).any():
        more = [np.arange(e - g + most, e, most) for e, g in zip(ends[gaps > most], gaps[gaps > most], strict=True)]
        ends = np.sort(np.concatenate([ends, *more]))
    return ends
