"""Vector transforms that are fitted on a gallery and applied anywhere: fit(df) -> model, model.transform(df).

What reaches the driver is a Gram matrix of dims x dims or one mean vector, whatever the number of rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from embergrid.functions import vectors as V


def _partial_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, gram = 0, None, None
    for b in batches:
        if b.num_rows:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            total, gram = (x.sum(0), x.T @ x) if total is None else (total + x.sum(0), gram + x.T @ x)
            n += len(x)
    if n:
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([total.tolist()]), pa.array([gram.ravel().tolist()])], names=["n", "total", "gram"])


def moments(vectors: DataFrame, column: str = "e") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance: one partial sum a task, added up on the way."""
    dims = vectors.select(F.size(column)).first()[0]
    parts = vectors.select(F.col(column).cast("array<double>").alias("e")).mapInArrow(_partial_gram, "n bigint, total array<double>, gram array<double>")
    sums = parts.select("n", F.posexplode(F.concat("total", "gram")).alias("i", "v")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    flat = np.zeros(dims + dims * dims)
    for r in sums:
        flat[r.i] = r.v
    n = sums[0].n
    mean = flat[:dims] / n
    return n, mean, flat[dims:].reshape(dims, dims) / n - np.outer(mean, mean)


def _moved(batches: Iterator[pa.RecordBatch], place: int, names: list[str], shift: np.ndarray, rows: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Batches with the vectors at `place` moved, projected and made unit length; null stays null."""
    for b in batches:
        column = b.column(place)
        some = column.is_valid().to_numpy(zero_copy_only=False)
        x = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(some.sum()), -1) if some.any() else np.zeros((0, len(shift)))
        x = x - shift
        x = x if rows is None else x @ rows.T
        x = x / (np.sqrt((x * x).sum(1, keepdims=True)) + V.EPS)
        ends = np.concatenate([[0], np.cumsum(some * x.shape[1])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1)), mask=pa.array(~some))
        yield pa.record_batch([lists if k == place else c for k, c in enumerate(b.columns)], names=names)


@dataclass
class Affine:
    """(x - shift) times rows of a matrix (or as it is), made unit length."""

    shift: list[float]
    rows: list[list[float]] | None = None

    def transform(self, vectors: DataFrame, column: str = "e") -> DataFrame:
        place, names = vectors.columns.index(column), vectors.columns
        shift, rows = np.array(self.shift), None if self.rows is None else np.array(self.rows)
        schema = StructType([StructField(column, ArrayType(DoubleType())) if f.name == column else f for f in vectors.schema.fields])
        return vectors.withColumn(column, F.col(column).cast("array<double>")).mapInArrow(partial(_moved, place=place, names=names, shift=shift, rows=rows), schema)


def fit_mean_centre(vectors: DataFrame) -> Affine:
    return Affine(moments(vectors)[1].tolist())


def _axes(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variances and axes, largest first; each axis points where its largest entry is positive."""
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    return values, axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])


def fit_all_but_top(vectors: DataFrame, d: int) -> Affine:
    """Centre, then remove the d leading axes."""
    _, mean, cov = moments(vectors)
    _, axes = _axes(cov)
    top = axes[:, :d]
    return Affine(mean.tolist(), (np.eye(len(mean)) - top @ top.T).tolist())


def fit_whitening(vectors: DataFrame, k: int, eps: float = 1e-6) -> Affine:
    """The k leading axes, each scaled to unit deviation."""
    _, mean, cov = moments(vectors)
    values, axes = _axes(cov)
    return Affine(mean.tolist(), (axes[:, :k] / (np.sqrt(np.maximum(values[:k], 0)) + eps)).T.tolist())


def source_centred(vectors: DataFrame, dims: int, source: str, strength: float = 1.0) -> DataFrame:
    """z - strength * (class-uniform mean of its source - class-uniform mean of all)."""
    mean = F.array(*[F.avg(F.col("e")[i]) for i in range(dims)])
    by_class = vectors.groupBy(source, "label").agg(mean.alias("e"))
    own = by_class.groupBy(source).agg(mean.alias("_own"))
    every = vectors.groupBy("label").agg(mean.alias("e")).agg(mean.alias("_all"))
    rows = vectors.join(own, source).join(F.broadcast(every))
    return rows.withColumn("e", V.minus(F.col("e"), V.scaled(V.minus(F.col("_own"), F.col("_all")), F.lit(strength)))).drop("_own", "_all")


FITTERS = {"mean-centre": fit_mean_centre, "all-but-top-3": lambda df: fit_all_but_top(df, 3), "whiten-16": lambda df: fit_whitening(df, 16)}
