"""Sorted numbers as bytes: gaps, by byte planes, compressed. What a task knows of a large array is sent in proportion to what it holds."""

from __future__ import annotations

import zlib

import numpy as np


def pack(numbers: np.ndarray) -> bytes:
    """numbers: sorted, below 2^32."""
    gaps = np.diff(numbers, prepend=0).astype("<u4")
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def runs(sorted_numbers: np.ndarray, shift: int):
    """(segment, slice) of each run of numbers that agree above the lowest `shift` bits."""
    if len(sorted_numbers):
        top = sorted_numbers >> shift
        edges = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(top[a]), slice(a, b)
