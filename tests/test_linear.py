"""The classifier from moments, the temperature passes, ranges and classes against NumPy and plain sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from embergrid.operators import calibration as C
from embergrid.operators import enrolment as E
from embergrid.operators import knn as N
from embergrid.operators import linear as L
from embergrid.operators import pooling as P
from embergrid.operators import ranking as R


def discriminant(e, y):
    """Equal diagonal covariances, fitted anew."""
    classes = np.unique(y)
    means = np.stack([e[y == c].mean(0) for c in classes])
    v = sum(((e[y == c] - m) ** 2).sum(0) for c, m in zip(classes, means, strict=True)) / len(e) + 1e-9
    return {int(c): (m / v, math.log((y == c).mean()) - (m * m / v).sum() / 2) for c, m in zip(classes, means, strict=True)}


def test_a_fold_less_is_a_fit_without_it(spark):
    rng = np.random.default_rng(1)
    e, y, fold = rng.normal(size=(200, 5)), rng.integers(0, 3, 200), rng.integers(0, 4, 200)
    e[np.arange(200), y] += 1.5
    rows = spark.createDataFrame([(int(f), int(c), i, [float(x) for x in v]) for i, (f, c, v) in enumerate(zip(fold, y, e, strict=True))], "fold int, cls int, id int, e array<double>")
    m = L.moments(rows, 5)
    found = {(r.fold, r.cls): (r.w, r.b) for r in L.discriminants(L.without_fold(m, 5), 5).collect()}
    for f in range(4):
        for c, (w, b) in discriminant(e[fold != f], y[fold != f]).items():
            assert np.allclose(found[f, c][0], w) and abs(found[f, c][1] - b) < 1e-9
    scored = L.scores(rows.withColumnRenamed("cls", "true"), L.discriminants(m, 5)).collect()
    assert len(scored) == 600 and np.mean([max((s.score, s.cls) for s in scored if s.id == i)[1] == y[i] for i in range(200)]) > 0.6


def test_temperature_is_the_least_of_a_fine_grid(spark):
    rng = np.random.default_rng(2)
    rows = [(seed, q, k, float(s), int(t)) for seed in (0, 1) for q in range(60) for t in [rng.integers(0, 5)] for k, s in enumerate(rng.normal(0, 0.1, 5) + 0.12 * (np.arange(5) == t))]
    rows += [(0, 99, k, 0.1, 7) for k in range(5)]  # a truth without a score is left out
    got = {r.seed: r for r in C.fit_temperature(spark.createDataFrame(rows, "seed int, q long, label long, score double, truth long")).collect()}
    for seed in (0, 1):
        s = np.array([[x[3] for x in rows if x[:2] == (seed, q)] for q in range(60)])
        t = np.array([next(x[4] for x in rows if x[:2] == (seed, q)) for q in range(60)])

        def loss(k, s=s, t=t):
            z = np.exp(k * (s - s.max(1, keepdims=True)))
            return -np.log((z / z.sum(1, keepdims=True))[np.arange(60), t] + 1e-12).mean()

        assert abs(got[seed].nll - loss(got[seed].scale)) < 1e-9
        assert loss(got[seed].scale) <= min(loss(k) for k in np.arange(1, 60, 0.01)) + 1e-6


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranges_number_like_one_sort(spark, by):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 3)), i, float(rng.choice([0.0, 1.5, -3.0, rng.normal()])), f"w{rng.integers(0, 40)}") for i in range(400)]
    df = spark.createDataFrame(rows, "g int, id int, v double, t string")
    got = {r.id: (r["rank"], r.n, round(r.upto, 9)) for r in R.ranged(df, by, [F.desc("v"), F.col("t"), F.col("id")], {"upto": F.col("v")}).collect()}
    for g in {r[0] for r in rows} if by else {None}:
        mine = sorted((r for r in rows if g is None or r[0] == g), key=lambda r: (-r[2], r[3], r[1]))
        for k, r in enumerate(mine):
            assert got[r[1]] == (k + 1, len(mine), round(math.fsum(x[2] for x in mine[: k + 1]), 9))


def test_first_of_orders_only_what_it_needs(spark):
    rows = spark.range(5000).selectExpr("id", "id % 2 as g", "md5(cast(id as string)) as d", "if(id % 2 = 0, 7, 0) as k")
    got = R.first_of(rows, ["g"], R.by_hash(F.col("d")), [F.col("d")], F.col("k")).collect()
    want = sorted((r.d, r.id) for r in rows.where("g = 0").collect())[:7]
    assert sorted((r.d, r.id) for r in got) == want and {r["rank"] for r in got} == set(range(1, 8))


def test_two_steps_enrol_as_one(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(int(rng.integers(0, 4)), [float(x) for x in rng.normal(size=3)]) for _ in range(90)] + [(None, [1.0, 1.0, 1.0]), (2, None), (9, [0.0, 1.0, 0.0])], "label long, e array<double>")
    parts = rows.withColumn("k", F.pmod(F.xxhash64("label", "e"), F.lit(2))).persist()
    both, once = str(tmp_path / "both"), str(tmp_path / "once")
    E.enrol(parts.where("k = 0"), both, 1, 3)
    E.enrol(parts.where("k = 1"), both, 2, 3)
    E.enrol(rows, once, 1, 3)
    key = lambda df: {r.label: (r.n, [round(x, 9) for x in r.total]) for r in df.collect()}
    assert key(E.state(spark, both, 3)) == key(E.state(spark, once, 3)) != key(E.state(spark, both, 3, upto=1))
    assert tuple(E.summary(E.state(spark, both, 3), 2).first()) == (91, 5, 4)
    with pytest.raises(Exception, match="(?i)exists"):
        E.enrol(rows, both, 2, 3)
    asked = spark.createDataFrame([(1, [0.0, 5.0, 0.0])], "q long, e array<double>")
    assert E.nearest_class(asked, E.prototypes(E.state(spark, both, 3))).first().label == 9


def test_a_large_vocabulary_is_joined(spark):
    rng = np.random.default_rng(5)
    e, c = rng.normal(size=(40, 6)), rng.normal(size=(70, 6))
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e)], "q long, e array<double>")
    classes = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "label long, e array<double>")
    want = {(i, k + 1): int(j) for i, row in enumerate(e @ c.T) for k, j in enumerate(np.argsort(-row)[:3])}
    for most in (100, 10):
        assert {(r.q, r["rank"]): r.label for r in N.best_classes(q, classes, 3, most).collect()} == want


def test_vector_pooling_equals_a_loop(spark):
    rng = np.random.default_rng(6)
    tokens = {i: rng.normal(size=(9, 4)) for i in (1, 2)}
    points = [(k, 1 if k < 50 else 2, float(rng.uniform(-5, 35)), float(rng.uniform(-5, 25))) for k in range(60)] + [(90, 3, 1.0, 1.0), (91, 1, None, 2.0)]
    grids = spark.createDataFrame([(i, t.ravel().tolist()) for i, t in tokens.items()], "image long, tokens array<double>")
    got = {(r.point, r.sigma): r.e for r in P.pool_tokens(spark.createDataFrame(points, "point long, image long, x double, y double"), grids, 3, (10.0, 7.0), (4.0, 9.0), part_rows=8).collect()}
    assert len(got) == 120
    for k, i, x, y in points[:60]:
        for s in (4.0, 9.0):
            w = np.array([math.exp(-(((c % 3 + 0.5) * 10 - x) ** 2 + ((c // 3 + 0.5) * 7 - y) ** 2) / (2 * s * s)) for c in range(9)])
            assert np.allclose(got[k, s], w @ tokens[i] / w.sum())
