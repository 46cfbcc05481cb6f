"""Vector expressions: worked out once a vector, and rounded as the SQL twins round."""

import math

import numpy as np
from pyspark.sql import functions as F

from embergrid.functions import vectors as V
from embergrid.operators import transforms as T
from embergrid.plans import QUERIES


def test_nested_units_are_worked_out_once(spark):
    """Each unit doubles nothing: eight within each other are as fast as one (they took 64^8 steps a row)."""
    e = [float(k % 7) - 2.5 for k in range(64)]
    row = spark.createDataFrame([(0, e), (1, None), (2, [])], "k int, e array<double>")
    x = F.col("e")
    for _ in range(8):
        x = V.unit(x)
    got = {r.k: r.x for r in row.select("k", x.alias("x")).collect()}
    want = np.array(e)
    for _ in range(8):
        want = want / (np.sqrt((want * want).sum()) + V.EPS)
    assert np.abs(np.array(got[0]) - want).max() < 1e-12 and got[1] is None and got[2] == []


def test_scaled_unit_and_projection_of_units(spark):
    row = spark.createDataFrame([([3.0, 4.0], [[1.0, 0.0], [1.0, 1.0]])], "e array<double>, m array<array<double>>")
    e, u = F.col("e"), V.unit_clamped(F.col("e"))
    r = row.select(V.scaled(e, 1 / V.norm(e)).alias("s"), V.project(u, F.col("m")).alias("p"), V.fuse(e, F.reverse(e), weights=(0.6, 0.8)).alias("f")).first()
    f = np.array([1.8, 2.4, 3.2, 2.4]) / 5
    assert np.allclose(r.s, [0.6, 0.8]) and np.allclose(r.p, [0.6, 1.4]) and np.allclose(r.f, f / np.sqrt(f @ f))


def small(spark, folder, values):
    """An embeddings table of vectors that hold `values` in the first six rows of their map, and 0.5 elsewhere; no class signal."""
    rows = [(k, 99, [v if i < 48 else 0.5 for i in range(64)]) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(folder + "/embeddings.parquet")
    return folder


def sign(x):
    return math.copysign(1.0, x)


def test_rounding_to_zero_keeps_the_sign(spark, tmp_path):
    rows = spark.createDataFrame([(-1e-8,), (1e-8,), (0.0,), (-0.0,), (-0.0000015,), (2.5e-6,), (None,)], "x double")
    got = [r.x for r in rows.select(V.rounded(F.col("x"), 6).alias("x")).collect()]
    assert got == [0, 0, 0, 0, -2e-6, 3e-6, None] and [sign(x) for x in got[:4]] == [-1, 1, 1, -1]


def test_region_queries_keep_the_sign_of_small_means(spark, tmp_path):
    data = small(spark, str(tmp_path), [-1e-8, 1e-8])
    contexts = {r.image: r.with_own for r in QUERIES["q_region_contexts"](spark, data).where("lab = 1").collect()}
    assert [[sign(x) for x in contexts[k]] for k in (0, 1)] == [[-1, -1], [1, 1]]
    vectors = {r.image: r.features for r in QUERIES["q_node_vectors"](spark, data).where("lab = 1").collect()}
    assert [{sign(x) for x in vectors[k][:16]} for k in (0, 1)] == [{-1}, {1}] and not any(vectors[0][:16])


def test_affine_keeps_nulls_and_the_other_columns(spark):
    """One matrix product a batch; 200 rows of 64 x 64 numbers took 64 times the steps as expressions."""
    rng = np.random.default_rng(3)
    m, shift = rng.normal(size=(64, 64)), rng.normal(size=64)
    e = [None if k % 50 == 3 else rng.normal(size=64).tolist() for k in range(200)]
    rows = spark.createDataFrame([(k, x, f"s{k}") for k, x in enumerate(e)], "vec_id long, e array<double>, name string")
    out = T.Affine(shift.tolist(), m.tolist()).transform(rows)
    assert out.columns == rows.columns
    for r in out.collect():
        assert r.name == f"s{r.vec_id}" and (r.e is None) == (e[r.vec_id] is None)
        if r.e is not None:
            y = m @ (np.array(e[r.vec_id]) - shift)
            assert np.allclose(r.e, y / (np.sqrt(y @ y) + V.EPS))
