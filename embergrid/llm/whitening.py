"""Whitening of embeddings from exact bit-sliced scatter.

Entries become integers x = floor(1024 c) + 100000. Each batch shifts a dimension by its least x and packs every bit plane across
rows into 64-bit words; the scatter is the weighted number of ones in the AND of two planes, summed over all pairs of planes, and shifted back. All of
it is integer, so sums over tasks are exact and in any order the same; they leave the tasks as one row for each pair of dimensions (in limbs of
40 bits) and are added by Spark. The driver gets the D (D + 1) / 2 sums of the table, centres them as integers, n Sum(x x') - S S', and
only then divides and takes the eigenvectors. A second pass projects the rows, a third adds up the whitened rows' covariance.

Cases: rows whose vector is null or has null or non-finite entries are dropped. Vectors of another length than the commonest one (of equally common
ones the longest) are dropped, too; empty vectors have no components. |x| is held at some 2^61; `deviation` is exact up to 38 digits, and
null beyond. Components of no variance (e at most 1e-12 of the largest) cannot be whitened and are left out; so rows that are all alike, or a table of
one row, give no rows, as an empty table does. Null and repeated ids and repeated rows each count and are kept. Other columns are ignored.
Long vectors cost D^2 in the driver; copies of a vector, however many, are rows as any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, tidy

SCALE, OFFSET = 1024.0, 100_000
LIMB = 40  # bits; 2^23 tasks can be added up
ROWS = 8192  # rows whose bit planes are packed at a time
MOST = 1 << 61  # differences stay in 64 bits
COMPONENTS = 8


def _clean(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, integer matrix) for each length of vector, of the rows without null or non-finite entries."""
    at = column.offsets.to_numpy()
    flat = column.values.cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    size = np.diff(at)
    good = (bad[at[1:]] == bad[at[:-1]]) & np.asarray(column.is_valid()) & (size > 0)
    for d in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == d))
        c = values[at[rows][:, None] + np.arange(d)]
        yield rows, np.clip(np.floor(SCALE * c), -float(MOST), float(MOST)).astype(np.int64) + OFFSET


def planes(u: np.ndarray) -> np.ndarray:
    """(dimension, bit, word): the bit planes of a matrix of integers >= 0, packed across rows into 64-bit words."""
    bits = int(u.max()).bit_length() or 1
    padded = np.zeros((-(-len(u) // 64) * 64, u.shape[1]), np.int64)
    padded[: len(u)] = u
    out = np.empty((u.shape[1], bits, len(padded) // 8), np.uint8)
    for b in range(bits):
        out[:, b] = np.packbits((padded >> b).astype(np.uint8) & 1, axis=0).T
    return out.view(np.uint64)


def cross_products(u: np.ndarray) -> np.ndarray:
    """Exact u'u of integers >= 0 by AND and popcount of bit planes; Python integers where 64 bits might not do."""
    p = planes(u)
    d, bits, _ = p.shape
    flat, wide = p.reshape(d * bits, -1), 2 * bits + len(u).bit_length() > 62
    weight = np.array([1 << b for b in range(bits)], object if wide else np.int64)
    out = np.zeros((d, d), weight.dtype)
    for i in range(d):
        for a in range(bits):
            ones = np.bitwise_count(flat[i * bits + a] & flat[i * bits :]).sum(1, dtype=np.int64).reshape(d - i, bits)
            out[i, i:] += (ones * (weight * weight[a])).sum(1)
    lower = np.tril_indices(d, -1)
    out[lower] = out.T[lower]
    return out


def _limbs(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, 40-bit parts with the sign) of Python integers, until nothing is left."""
    sign, rest, k = np.where(values < 0, -1, 1), np.abs(values), 0
    while k == 0 or rest.any():
        yield k, (sign * (rest % (1 << LIMB))).astype(np.int64)
        rest, k = rest // (1 << LIMB), k + 1


@tidy
def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length of vector: (dims, i, j, limb, v) with sums of x_i x_j; of x_j under i = -1; and the number of rows under i = j = -1."""
    total: dict[int, list] = {}
    for b in batches:
        for _, x in _clean(b.column(0)):
            d = x.shape[1]
            n, s, m = total.setdefault(d, [0, np.zeros(d, object), np.zeros((d, d), object)])
            for k in range(0, len(x), ROWS):
                part = x[k : k + ROWS]
                least = part.min(0)
                u = (part - least).astype(np.int64)
                sums, low, rows = u.astype(object).sum(0) if int(u.max()) > 1 << 48 else u.sum(0).astype(object), least.astype(object), len(part)
                n += rows
                s = s + sums + rows * low
                m = m + cross_products(u).astype(object) + np.outer(low, sums) + np.outer(sums, low) + rows * np.outer(low, low)
            total[d] = [n, s, m]
    for d, (n, s, m) in total.items():
        i, j = np.triu_indices(d)
        i, j, values = np.concatenate([[-1], np.full(d, -1), i]), np.concatenate([[-1], np.arange(d), j]), np.concatenate([[n], s, m[i, j]]).astype(object)
        for limb, v in _limbs(values):
            keep = np.flatnonzero(v) if limb else np.arange(len(v))
            yield pa.record_batch([pa.array(np.full(len(keep), d, np.int32)), pa.array(i[keep].astype(np.int32)), pa.array(j[keep].astype(np.int32)), pa.array(np.full(len(keep), limb, np.int32)), pa.array(v[keep])], names=["dims", "i", "j", "limb", "v"])


def scatter(vectors: DataFrame, vec_col: str = "embedding") -> tuple[int, int, np.ndarray, np.ndarray]:
    """Dimensions, n, S and Sum(x x') of the table, in Python integers."""
    parts = vectors.select(F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(_scatter, "dims int, i int, j int, limb int, v bigint")
    sums = staged(parts.groupBy("dims", "i", "j", "limb").agg(F.sum("v").alias("v")), "scatter")
    best = sums.where("i = -1 and j = -1").groupBy("dims").agg(F.sum(F.col("v") * F.pow(F.lit(2.0), LIMB * F.col("limb"))).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if best is None:
        return 0, 0, np.zeros(0, object), np.zeros((0, 0), object)
    d = best.dims
    n, s, m = 0, np.zeros(d, object), np.zeros((d, d), object)
    for r in sums.where(F.col("dims") == d).toLocalIterator():
        value = int(r.v) << (LIMB * r.limb)
        if r.i >= 0:
            m[r.i, r.j] += value
            m[r.j, r.i] = m[r.i, r.j]
        elif r.j >= 0:
            s[r.j] += value
        else:
            n += value
    return d, n, s, m


class Whitening:
    """Mean, components and eigenvalues of a table; small: D x `components` numbers."""

    def __init__(self, dims: int, n: int, sums: np.ndarray, products: np.ndarray, components: int = COMPONENTS):
        self.dims, self.n, self.sums = dims, n, sums
        centred = n * products - np.outer(sums, sums)  # exact integers
        self.covariance = np.array([[float(Fraction(v, n * n)) if v else 0.0 for v in row] for row in centred.tolist()]).reshape(dims, dims)
        e, u = np.linalg.eigh(self.covariance) if dims else (np.zeros(0), np.zeros((0, 0)))
        self.trace = float(Fraction(sum(centred.diagonal().tolist()), n * n)) if n else 0.0
        order = [k for k in np.argsort(-e, kind="stable")[:components] if e[k] > 1e-12 * max(e.max(), 0) and e[k] > 0]
        self.values, self.vectors = e[order], u[:, order]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S: Python integers where 64 bits might not do."""
        most = int(np.abs(x).max()) if x.size else 0
        if 2 * self.n * max(most, 1) * (1 + most) < 1 << 62 and all(abs(v) < 1 << 61 for v in self.sums):
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n x - S) as integers, and the whitened rows."""
        c = self.centred(x)
        return c, (np.array([[float(Fraction(v, self.n)) for v in r] for r in c.tolist()]) if c.dtype == object else c / self.n) @ (self.vectors / np.sqrt(self.values))


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    return Whitening(*scatter(vectors, vec_col), components)


@tidy
def _white_sums(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    w = model.value
    k = len(w.values)
    n, s, m = 0, np.zeros(k), np.zeros((k, k))
    for b in batches:
        for _, x in _clean(b.column(0)):
            if x.shape[1] == w.dims:
                y = w.project(x)[1]
                n, s, m = n + len(y), s + y.sum(0), m + y.T @ y
    if n:
        i, j = np.triu_indices(k)
        i, j, v = np.concatenate([np.full(k, -1), i]), np.concatenate([np.arange(k), j]), np.concatenate([s, m[i, j]])
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(v)], names=["i", "j", "v"])


def identity_error(vectors: DataFrame, model: Whitening, vec_col: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, measured on all rows."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)
    parts = vectors.select(F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(partial(_white_sums, model=sent), "i int, j int, v double")
    cov, mean = np.zeros((k, k)), np.zeros(k)
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # (k + 1) (k + 2) / 2 rows at most
        if r.i < 0:
            mean[r.j] = r.v / model.n
        else:
            cov[r.i, r.j] = cov[r.j, r.i] = r.v / model.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0


ROW = "vec_id bigint, component int, deviation decimal(38,0), whitened double"


@tidy
def _project(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    w = model.value
    k, kind = len(w.values), pa.decimal128(38, 0)
    for b in batches:
        for rows, x in _clean(b.column(1)):
            if x.shape[1] != w.dims:
                continue
            c, y = w.project(x)
            if c.dtype == object or w.dims * int(np.abs(c).max()) ** 2 >= 1 << 63:
                deviation = pa.array([v if v < 10**38 else None for v in (sum(e * e for e in r) for r in c.tolist())], kind)
            else:
                deviation = pa.array((c * c).sum(1)).cast(kind)
            each = pa.array(np.repeat(np.arange(len(rows)), k))
            yield pa.record_batch([b.column(0).take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), deviation.take(each), pa.array(y.reshape(-1))], names=["vec_id", "component", "deviation", "whitened"])


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each remaining vector and component: vec_id, component (from 1), deviation (exact), whitened."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(partial(_project, model=vectors.sparkSession.sparkContext.broadcast(model)), ROW)


def report(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``whiten`` with n, the share of variance that each component explains, and the identity error of the whole table."""
    share = F.element_at(F.array(*[F.lit(float(e / model.trace)) for e in model.values]), F.col("component")) if len(model.values) else F.lit(None).cast("double")
    return whiten(vectors, model, id_col, vec_col).withColumns({"n": F.lit(model.n).cast("long"), "explained": share, "identity_error": F.lit(identity_error(vectors, model, vec_col))})
