"""Byte-level word work on Arrow string columns with numpy.

The word rule of every operator here is ``[^\\x20\\x09-\\x0D]+``. Both its separators and A-Z are ASCII, so words and
their lower case can be found on UTF-8 bytes without decoding. Words become 64-bit hashes; shingle sets are sets of
64-bit hashes, so two different shingles are taken for one with a chance of about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _RNG.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        steps = np.full(max(n, CHUNK + 1), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _POWERS[kind] = np.multiply.accumulate(steps)
    return _POWERS[kind]


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within them) of a string column, null as empty, about ``limit`` bytes each."""
    for row, part in _arrays(column):
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(part):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            end = min(end, len(part))
            yield row + at, row + end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def _arrays(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    row = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = pc.fill_null(part.cast(pa.large_string()), "")
        yield row, part
        row += len(part)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (in bytes) of every word, and for every document the number of words before it (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    joined = np.ones(len(data) + 1, bool)
    joined[edge] = False
    first[1:] &= ~(solid[:-1] & joined[1:-1])
    last[:-1] &= ~(solid[1:] & joined[1:-1])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes (a polynomial over a random byte table, then mixed)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", len(data))[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's ``size``-word windows in order, and their bounds by document.

    With fewer words the whole sequence is one shingle; a document without words has none.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    total = len(hashes)
    wide = np.zeros(max(total - size + 1, 0), np.uint64)
    for k in range(size):
        wide += hashes[k : k + len(wide)] * _STEP[k]
    at = np.arange(out[-1]) - np.repeat(out[:-1], n) + np.repeat(bounds[:-1], n)
    result = np.zeros(out[-1], np.uint64)
    full = np.repeat(counts >= size, n)
    result[full] = wide[at[full]]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        own = hashes[bounds[d] : bounds[d + 1]]
        result[out[d]] = (own * _STEP[8 : 8 + len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(result), out


def shingle_sets(column: pa.Array | pa.ChunkedArray, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every document, lower-cased in A-Z."""
    for row, _, data, offsets in text_chunks(column):
        data = LOWER[data]
        starts, ends, bounds = words(data, offsets)
        shingles, cuts = shingle_hashes(word_hashes(data, starts, ends), bounds, size)
        for d in range(len(cuts) - 1):
            yield row + d, np.unique(shingles[cuts[d] : cuts[d + 1]])
