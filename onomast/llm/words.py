r"""Words `[^\x20\x09-\x0D]+` of many texts at once, as 64-bit hashes, without a Python step per word.

A word's hash is a polynomial over random 64-bit values of its bytes, modulo 2^64, finished by a
mixer together with its length. Prefix sums over a block of bytes give all its words' polynomials; the
odd base has an inverse, which takes a word's place in the block out again. Blocks have a fixed size, so
memory is bounded by the texts themselves, however long they are.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

LOWER = bytes(range(256)).lower()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8, person=b"word").digest(), "little") for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
BLOCK = 1 << 17  # bytes


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on arrays."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for the places of a block."""
    up, down = np.full(BLOCK + 1, _BASE, np.uint64), np.full(BLOCK + 1, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _long_word(data: np.ndarray) -> np.uint64:
    """The polynomial of a word that is longer than a block."""
    up, total = _powers()[0], 0
    for at in range(0, len(data), BLOCK):
        part = _VALUE[data[at : at + BLOCK]]
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return np.uint64(total & ((1 << 64) - 1))


def hashed_words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and the number of words of each text."""
    raw = [(t or "").encode() for t in texts]
    whole = b"\n" + b"\n".join(raw) + b"\n"
    if lower:
        whole = whole.translate(LOWER)
    data = np.frombuffer(whole, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    h, (up, down), i = np.zeros(len(start), np.uint64), _powers(), 0
    while i < len(start):  # as many words as a block holds, or one that is longer
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
        a, b = int(start[i]), int(end[j - 1])
        if b - a > BLOCK:
            h[i] = _long_word(data[a:b])
        else:
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_VALUE[data[a:b]] * up[: b - a], out=sums[1:])
            h[i:j] = (sums[end[i:j] - a] - sums[start[i:j] - a]) * down[start[i:j] - a]
        i = j
    ends = np.cumsum([len(r) + 1 for r in raw]) + 1
    per_text = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    return mix(h + (end - start).astype(np.uint64)), per_text.astype(np.int64)
