"""Packed messages between folds of documents and parts of a hash space.

A fold holds the documents of about a fixed number of tokens or shingles; it sends each of its distinct keys once, with
what it has to say about it, to the part of the hash space that owns the key. So a key that a third of all documents
hold is one entry a fold, and what meets in one task is bounded by the number of folds, not of rows. Keys travel sorted,
as differences, in byte planes: some three bytes each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as 64-bit integers in byte planes, compressed."""
    planes = [np.ascontiguousarray(x).astype(np.int64, copy=False).view(np.uint8).reshape(-1, 8).T.tobytes() for x in columns]
    return pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpack(data, n: int, columns: int = 1) -> list[np.ndarray]:
    if not n:
        return [np.zeros(0, np.int64)] * columns
    raw = np.frombuffer(pa.decompress(data, 8 * n * columns, "zstd"), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(x.T).view(np.int64).ravel() for x in raw]


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted unsigned keys as differences, which pack well; ``from_steps`` gives them back."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.int64)


def from_steps(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences.view(np.uint64), dtype=np.uint64)


def by_part(keys: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(part, start, end) of sorted keys; a part is a key's bits from ``shift`` on."""
    part, start = np.unique(keys >> np.uint64(shift), return_index=True)
    return list(zip(part.tolist(), start.tolist(), [*start.tolist()[1:], len(keys)], strict=True))
