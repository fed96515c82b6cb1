"""Vectorised words and word shingles of whole Arrow text columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z. They are hashed
with numpy over the column's own buffer, so no Python object is made per word. A shingle is the
64-bit hash of five consecutive word hashes; a shorter document is one shingle of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
CHUNK_BYTES = 1 << 20
SLICE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, cache: list[np.ndarray] = [np.ones(1, dtype=np.uint64)]) -> np.ndarray:  # noqa: B006
    if len(cache[0]) < n:
        table = np.full(1 << int(n).bit_length(), _BASE, dtype=np.uint64)
        table[0] = 1
        cache[0] = np.multiply.accumulate(table)
    return cache[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive row ranges of about ``limit`` bytes: (first row, texts), nulls as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, texts.slice(first, last - first)
        first = last


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every row) of a large_binary array without nulls."""
    rows = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1]
    base = int(offsets[0])
    size = int(offsets[-1]) - base
    counts = np.zeros(rows, np.int64)
    if not size:
        return np.zeros(0, np.uint64), counts
    data = np.frombuffer(texts.buffers()[2], np.uint8)[base : base + size]
    edges = offsets - base
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = np.unique(edges[(edges > 0) & (edges < size)])  # a row's end also ends a word
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(starts, edges))
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # chunks of whole words bound the temporary arrays
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, side="right")))
        lengths = ends[at:to] - starts[at:to]
        heads = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        values = (_LOWER[data[place + np.repeat(starts[at:to], lengths)]].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place]
        out[at:to] = np.add.reduceat(values, heads) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = to
    return mix(out), counts


def shingle_lists(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in text order with repeats, bounds of every row in them)."""
    words, counts = word_hashes(texts)
    word_bounds = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(bounds[-1]), np.uint64)
    if len(words) >= width:
        joint = np.zeros(len(words) - width + 1, np.uint64)
        for step in range(width):
            joint += words[step : len(words) - width + 1 + step] * _STEPS[step]
        long = counts >= width
        source = np.repeat(word_bounds[:-1][long] - bounds[:-1][long], sizes[long])
        target = np.flatnonzero(np.repeat(long, sizes))
        out[target] = joint[target + source]
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[word_bounds[row] : word_bounds[row + 1]]
        out[bounds[row]] = (own * _STEPS[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(out), bounds


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct shingles in ascending order) for every row of any text array."""
    for first, part in slices(texts):
        hashes, bounds = shingle_lists(part, width)
        for row in range(len(part)):
            yield first + row, np.unique(hashes[bounds[row] : bounds[row + 1]])
