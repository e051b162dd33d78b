"""Hashes of the words of many texts at once.

Words are maximal runs of bytes other than space and controls 9 to 13, with A-Z lower-cased. A word's hash is a sum of
its bytes, each times an odd random number for its place, mixed with its length: two different words share a hash with
a probability of 2^-57 at most over the choice of those numbers. Words of over 255 bytes are hashed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_LONGEST = 255
_PLACES = np.random.default_rng(77).integers(1, 2**63, _LONGEST + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are worked on at a time, or one text.
SPAN = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts that ``offsets`` cut out of ``data``, and how many each text has."""
    n_texts = len(offsets) - 1
    data = _LOWER[data]
    solid = ~_BLANK[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = solid[edges]  # a text begins a word, whatever stands before it
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n_texts, np.int64)
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | begins[1:]
    lengths = np.flatnonzero(ends) + 1 - starts
    inside = np.flatnonzero(solid)  # bytes of words, so that words follow each other without gaps
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    np.minimum(place, _LONGEST, out=place)
    weighed = _PLACES.take(place)
    weighed *= data[inside].astype(np.uint64)
    hashes = mix(np.add.reduceat(weighed, first) + lengths.astype(np.uint64) * _M3)
    for k in np.flatnonzero(lengths > _LONGEST).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : starts[k] + lengths[k]].tobytes())
    return hashes, np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=n_texts)


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, hashes of the words of a run of texts, how many each has) over all ``texts``; null has none."""
    column = texts.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        stop = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SPAN, "right")) - 1))
        bounds = offsets[at : stop + 1]
        yield at, *_hashed(data[bounds[0] : bounds[-1]], bounds - bounds[0])
        at = stop


def hash_of(word: bytes) -> int:
    """The hash of one word, as an unsigned number."""
    return int(next(hashed_words(pa.array([word])))[1][0])
