"""Bloom filters of 64-bit hash pairs, built in parallel and merged segment by segment.

A filter is a bit array of a power of two. Every row sets two bits. Beside the bits of all rows ("seen") a
second array holds the bits of rows that were met twice ("repeated"). Two partial pairs merge as
``repeated = r1 | r2 | (s1 & s2)`` and ``seen = s1 | s2``, so map tasks work alone and merges stream.

A map task sends the positions of its bits, a few bytes a row, and holds at most FLUSH rows; whole arrays are
made segment by segment where they merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import sparse
from .common import next_pow2, tidy

SEGMENT = 20  # bits of a position within a segment
SEGMENT_BITS = 1 << SEGMENT
FLUSH = 1 << 20
SCHEMA = "segment int, seen binary, repeated binary"


def filter_bits(rows: int, bits_per_row: int, max_bits: int) -> int:
    return int(min(max(next_pow2(max(rows, 1) * bits_per_row), 1 << 13), max_bits))


def positions(pair: np.ndarray, bits: int) -> np.ndarray:
    """pair: (n, 2) uint64 -> bit positions."""
    return (pair & np.uint64(bits - 1)).astype(np.int64)


def test(array: np.ndarray, pair: np.ndarray) -> np.ndarray:
    p = positions(pair, array.size * 8)
    return ((array[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=1)


def pairs_of(column: pa.Array) -> np.ndarray:
    """16 bytes or more per row, not null -> (n, 2) uint64."""
    if not len(column):
        return np.zeros((0, 2), np.uint64)
    return np.frombuffer(b"".join(x[:16] for x in column.to_pylist()), "<u8").reshape(-1, 2)


def _sent(pairs: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Positions of the rows' bits by segment, and of those rows whose first word is met twice (at worst a false positive)."""
    pair = np.concatenate(pairs)
    _, back, count = np.unique(pair[:, 0], return_inverse=True, return_counts=True)
    seen, twice = np.unique(positions(pair, bits)), np.unique(positions(pair[count[back] > 1], bits))
    again = dict(sparse.runs(twice, SEGMENT))
    rows = []
    for k, at in sparse.runs(seen, SEGMENT):
        low = SEGMENT_BITS - 1
        rows.append((k, sparse.pack(seen[at] & low), sparse.pack(twice[again.get(k, slice(0, 0))] & low)))
    for k in range(0, len(rows), 64):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["segment", "seen", "repeated"])


@tidy
def _build(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(pairs_of(b.column(0)))
            n += b.num_rows
        if n >= FLUSH:
            yield from _sent(held, bits)
            held, n = [], 0
    if held:
        yield from _sent(held, bits)


def _merge(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by segment: one pair of arrays is held at a time."""
    now, seen, repeated = None, None, None

    def out():
        return pa.record_batch([pa.array([now], pa.int32()), *(pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary()) for x in (seen, repeated))], names=["segment", "seen", "repeated"])

    for b in batches:
        for k, s, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != now:
                if now is not None:
                    yield out()
                now, seen, repeated = k, np.zeros(size, bool), np.zeros(size, bool)
            s = sparse.unpack(s)
            repeated[s[seen[s]]] = True
            repeated[sparse.unpack(r)] = True
            seen[s] = True
    if now is not None:
        yield out()


def build(hashes: DataFrame, bits: int, repeated: bool) -> np.ndarray:
    """hashes: one binary column of 16 bytes or more. Returns the merged bits, max_bits / 8 bytes at most."""
    parts = hashes.mapInArrow(partial(_build, bits=bits), SCHEMA)
    size, segments = min(bits, SEGMENT_BITS), max(1, bits // SEGMENT_BITS)
    whole = parts.repartition(min(segments, 256), "segment").sortWithinPartitions("segment").mapInArrow(partial(_merge, size=size), SCHEMA)
    out = np.zeros(bits // 8, np.uint8)
    for k, b in whole.select("segment", "repeated" if repeated else "seen").collect():  # max_bits bound it
        out[k * size // 8 : (k + 1) * size // 8] = np.frombuffer(b, np.uint8)
    return out
