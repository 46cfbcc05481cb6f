"""Near-duplicate grouping of resources and union of their records."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embergrid.functions import vectors as V
from embergrid.sources.shared import staged

from . import suppression

CELL_ROWS = 1 << 17
TILE = (16, 4096)  # hashes compared at a time
HITS = 1 << 14  # pairs that leave together
TASKS, FEW = 3, 8192  # pairs of cells for each core, and rows of a cell, at least
SPREAD = 8  # partitions for each pair of cells, so that few pairs share one


def content_groups(rows: DataFrame, key: str, content: str) -> DataFrame:
    """sha, canonical (least key), copies: one row for each content. Partial aggregation in the map tasks."""
    return rows.groupBy(F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("sha")).agg(F.min(key).alias("canonical"), F.count(F.lit(1)).alias("copies"))


def difference_hash(values: Column, width: int) -> Column:
    """Bits of value[i] < value[i + 1] along rows of a row-major grid, as one long."""

    def bits(v: Column) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(1), F.size(v) - 1), lambda i: i % width != 0), lambda i: F.when(F.element_at(v, i + 1) > F.element_at(v, i), "1").otherwise("0"))

    return F.conv(F.array_join(V.once(values, bits), ""), 2, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _centred(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors less their mean, of length 1 and filled up with zeros, and their sizes: below zero where an entry or all is null."""
    lists = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    flat = lists.flatten()
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), size.max(initial=0)))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat.to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", divide="ignore"):
        out -= np.where(np.arange(out.shape[1]) < size[:, None], (out.sum(1) / size)[:, None], 0.0)
        out /= np.sqrt((out * out).sum(1))[:, None]
    size = np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, size)
    size[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, size


def _near_hashes(rows: pa.Table, most: int) -> Iterator[pa.RecordBatch]:
    """Pairs at distance <= most of one pair of cells, by XOR and popcount of tiles that stay in a core's cache; only hits leave, with their vectors' correlation if there are vectors."""
    i, cell = rows.column("_i")[0].as_py(), rows.column("_c").to_numpy()
    key, h = rows.column("a").to_numpy(), rows.column("h").to_numpy().view(np.uint64)
    own = rows.column("_j")[0].as_py() == i
    unit, size = _centred(rows.column("e")) if "e" in rows.column_names else (None, None)
    left = np.flatnonzero(cell == i)
    right = left if own else np.flatnonzero(cell != i)
    theirs = h[right]
    word, count, near = (np.empty(TILE[0] * TILE[1] + 8, t) for t in (np.uint64, np.uint8, bool))

    def batch(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y, d = (v[key[x] != key[y]] for v in (x, y, d))
        for k in range(0, len(x), HITS):
            p, q = x[k : k + HITS], y[k : k + HITS]
            columns = [pa.array(np.minimum(key[p], key[q])), pa.array(np.maximum(key[p], key[q])), pa.array(d[k : k + HITS].astype(np.int32))]
            if unit is not None:
                columns.append(pa.array(np.einsum("ij,ij->i", unit[p], unit[q]), mask=(size[p] != size[q]) | (size[p] < 0)))
            yield pa.record_batch(columns, names=["a", "b", "distance", "corr"][: len(columns)])

    found, n = [], 0
    for r in range(0, len(left), TILE[0]):
        mine = h[left[r : r + TILE[0]], None]
        for c in range(r // TILE[1] * TILE[1] if own else 0, len(theirs), TILE[1]):
            other = theirs[None, c : c + TILE[1]]
            pairs, wide = mine.size * other.size, other.size
            w, d, hit = (v[:pairs].reshape(-1, wide) for v in (word, count, near))
            np.bitwise_xor(mine, other, out=w)
            np.bitwise_count(w, out=d)
            np.less_equal(d, most, out=hit)
            near[pairs : -(-pairs // 8) * 8] = False
            eight = near[: -(-pairs // 8) * 8].view(np.uint64)  # few of which hold a hit
            some = np.flatnonzero(eight)
            if len(some):
                x, y = np.nonzero(eight[some].view(bool).reshape(-1, 8))
                at = some[x] * 8 + y
                far = count[at]
                x, y = np.divmod(at, wide)
                x, y = x + r, y + c
                if own:
                    x, y, far = (v[y > x] for v in (x, y, far))
                found.append((left[x], right[y], far))
                n += len(x)
            if n >= HITS:
                yield from batch(*map(np.concatenate, zip(*found, strict=True)))
                found, n = [], 0
    if n:
        yield from batch(*map(np.concatenate, zip(*found, strict=True)))


def cells(rows: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """a, h (and e) with their cell _c and each pair of cells (_i <= _j) they meet under: a row is copied once for each cell."""
    return _cells(rows, max(1, -(-rows.count() // cell_rows)))


def _cells(rows: DataFrame, n: int) -> DataFrame:
    own = F.pmod(F.xxhash64("a"), F.lit(n)).cast("int")  # by key, so that copies of a hash are spread
    dealt = rows.withColumn("_c", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.withColumns({"_i": F.least("_c", "_o"), "_j": F.greatest("_c", "_o")}).drop("_o")


def hamming_pairs(rows: DataFrame, key: str, hash_col: str, most: int, cell_rows: int = CELL_ROWS, vector: str | None = None) -> DataFrame:
    """Pairs a < b of keys at Hamming distance <= most; with a vector column also their Pearson correlation `corr`. Hashes are dealt out over cells, of cell_rows
    at most and so many that all cores have work; each pair of cells is compared in one task as packed 64-bit words, which is exact for any distance.
    A row is shuffled once for each cell, 16 bytes and its vector; candidates are never emitted."""
    columns = [F.col(key).cast("long").alias("a"), F.col(hash_col).cast("long").alias("h")] + ([F.col(vector).cast("array<double>").alias("e")] if vector else [])
    hashes = staged(rows.select(*columns), "hashes").where("a is not null and h is not null")  # counted and dealt; hashes are dear to work out
    n = hashes.count()
    wanted = math.isqrt(2 * TASKS * hashes.sparkSession.sparkContext.defaultParallelism) + 1
    k = max(1, -(-n // cell_rows), min(wanted, -(-n // FEW)))
    parts = min(k * (k + 1) // 2 * SPREAD, 2048)  # a number of its own: some shuffle partitions would get two or three pairs, others none

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _near_hashes(pa.Table.from_batches(batches), most)

    return _cells(hashes, k).repartition(parts, "_i", "_j").groupBy("_i", "_j").applyInArrow(near, "a bigint, b bigint, distance int" + (", corr double" if vector else ""))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two numeric arrays."""

    def centred(x: Column) -> Column:
        mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y) / F.size(v)
        return V.once(x, lambda v: V.once(F.struct(v.alias("v"), mean(v).alias("m")), lambda s: F.transform(s["v"], lambda y: y - s["m"])))

    return V.once(F.struct(centred(a).alias("a"), centred(b).alias("b")), lambda s: V.dot(s["a"], s["b"]) / (V.norm(s["a"]) * V.norm(s["b"])))


def canonical(rows: DataFrame, group: str, key: str, preferred: Column, area: Column) -> DataFrame:
    """Member that stands for its group: preferred source first, then the largest area, then the least key."""
    best = F.min(F.struct((~preferred).alias("other"), (-area).alias("size"), F.col(key).alias("canonical")))
    return rows.groupBy(group).agg(best.alias("m"), F.count(F.lit(1)).alias("members")).select(group, "m.canonical", "members")


def mapped_points(rows: DataFrame, group: str, frame: str, source: Column, area: Column) -> DataFrame:
    """Points of a group's frames in the frame of its canonical member: rows with canonical, its w and h, x and y there, and `moved`."""
    best = canonical(rows.select(group, frame, source.alias("_p"), area.alias("_a")).distinct(), group, frame, F.col("_p"), F.col("_a"))
    frames = rows.select(F.col(frame).alias("canonical"), F.col("w").alias("cw"), F.col("h").alias("ch")).distinct()
    met = rows.join(best.select(group, "canonical"), group).join(frames, "canonical")
    moved = {"x": V.rescale(F.col("x"), F.col("w"), F.col("cw")), "y": V.rescale(F.col("y"), F.col("h"), F.col("ch")), "moved": F.col(frame) != F.col("canonical")}
    return met.withColumns(moved).drop("w", "h").withColumnsRenamed({"cw": "w", "ch": "h"})


def greedy_points(rows: DataFrame, by: list[str], order: list[str], d: int = 35, **options) -> DataFrame:
    """Keep a point unless a kept one of the same group is within |dx| < d and |dy| < d; in order. See suppression."""
    return suppression.greedy(rows, by, order, d, **options)
