"""Numpy helpers that hash words and word shingles of a batch of texts inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in slices of about so many bytes, so that a task's memory doesn't follow its batch.
SLICE_BYTES = 2_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads 64-bit values over their range."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices of a string array; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(texts))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased, unless fold is false) of each text, and the number of words before each text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(~_SPACE[data])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    fresh = np.empty(len(at), dtype=bool)
    fresh[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=fresh[1:])
    inner = np.searchsorted(at, offsets[1:-1])
    fresh[inner[inner < len(at)]] = True
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()) - 1, _BASE, np.uint64)]))
    h = np.add.reduceat(_BYTE[_LOW[data[at]] if fold else data[at]] * powers[place], starts)
    return mixed(h + sizes.astype(np.uint64) * _PLACE[63]), np.searchsorted(at[starts], offsets)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text; a text of fewer words has its whole sequence."""
    for _, data, offsets in text_slices(texts):
        words, before = word_hashes(data, offsets)
        n = max(len(words) - k + 1, 0)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h += words[j : j + n] * _PLACE[j]
        h = mixed(h)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= k:
                own = np.sort(h[a : b - k + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                yield mixed((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _PLACE[40 + b - a : 41 + b - a])
            else:
                yield np.zeros(0, np.uint64)


def digest(*parts: bytes) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(p)
    return h.digest()
