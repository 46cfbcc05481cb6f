"""The k-nearest join by pivots against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embergrid.operators import dedup as D
from embergrid.operators import knn as N
from embergrid.operators import retrieval as R
from embergrid.plans import QUERIES


def frames(spark, e, ids=None):
    ids = range(len(e)) if ids is None else ids
    rows = spark.createDataFrame([(int(i), int(i) % 7, int(i), 1, [float(x) for x in v]) for i, v in zip(ids, e, strict=True)], "vec_id long, label long, unit long, mask long, e array<double>")
    return rows, rows.selectExpr("vec_id as q", "e"), rows.selectExpr("vec_id as g", "label", "e")


def brute(asked, gallery, k, ids=None):
    sims = np.round(asked @ gallery.T, 9)
    own = np.arange(len(asked))
    sims[own, own] = -np.inf
    return {q: sorted(np.arange(len(gallery))[sims[q] > -np.inf].tolist(), key=lambda g: (-sims[q, g], g))[:k] for q in own.tolist()}


def found(df, decimals=9):
    out = {}
    for r in df.collect():
        out.setdefault(r.q, []).append((-round(r.sim, decimals), r.g))
    return {q: [g for _, g in sorted(v)] for q, v in out.items()}


def unit(e):
    return e / np.linalg.norm(e, axis=1, keepdims=True)


def clusters(rng, n, centres, spread=0.02, dims=16):
    c = unit(rng.normal(size=(centres, dims)))
    return unit(c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims)))


@pytest.mark.parametrize("kind", ["clustered", "uniform", "copies", "lengths"])
def test_join_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(7)
    e = clusters(rng, 600, 20) if kind == "clustered" else unit(rng.normal(size=(600, 16)))
    if kind == "copies":
        e[::3] = e[0]  # a third of all rows are one vector
    if kind == "lengths":
        e *= rng.uniform(0.2, 3.0, (600, 1))
    _, q, g = frames(spark, e)
    assert found(N.join(q, g, 5, cell_rows=25, block_rows=64)) == brute(e, e, 5)


def test_copies_of_a_row(spark):
    """On clusters a row goes to few groups, on vectors without structure to one for each block of queries."""
    rng = np.random.default_rng(8)
    _, q, g = frames(spark, clusters(rng, 3000, 60))
    left, right = N.dealt(q, g, 5, cell_rows=50, block_rows=100)
    near = right.count() / 3000, left.count() / 3000
    _, q, g = frames(spark, unit(rng.normal(size=(3000, 16))))
    left, right = N.dealt(q, g, 5, cell_rows=50, block_rows=1500)
    far = right.count() / 3000, left.count() / 3000
    assert near[0] < 3000 / 100 / 6 and near[1] < 6 and far[0] <= 4 and far[1] <= 4


def test_groups_and_blocks_are_bounded(spark):
    rng = np.random.default_rng(9)
    e = unit(rng.normal(size=(900, 8)))
    e[:400] = e[0]
    _, q, g = frames(spark, e)
    for side in N.dealt(q, g, 3, cell_rows=30, block_rows=100):
        assert side.groupBy("grp", "blk").count().agg({"count": "max"}).first()[0] <= 160  # cut by hash: 100 on average


def test_nearest_takes_pivots_past_a_block(spark):
    e = clusters(np.random.default_rng(10), 300, 10)
    rows, _, _ = frames(spark, e)
    few = R.nearest(rows, rows, 4)  # broadcast
    many = R.nearest(rows, rows, 4, block=50)
    assert many.columns == few.columns and found(few) == found(many) == brute(e, e, 4)
    half = rows.withColumn("mask", rows.vec_id % 2 + 2)
    got = found(R.nearest(half, half, 2, seeds=(0,), block=50))
    odd = brute(e[1::2], e[1::2], 2)
    assert got == {2 * q + 1: [2 * g + 1 for g in v] for q, v in odd.items()}


def test_small_tables(spark):
    rows, q, g = frames(spark, unit(np.random.default_rng(11).normal(size=(3, 4))))
    assert {k: len(v) for k, v in found(N.join(q, g, 5)).items()} == {0: 2, 1: 2, 2: 2}
    assert N.join(q.limit(0), g, 5).isEmpty() and N.join(q, g.limit(0), 5).isEmpty()
    assert R.nearest(rows, rows.limit(0), 5).isEmpty()


def test_cells_are_tiled(spark):
    """Sums over all rows: several cells and tiles give what one matrix gives."""
    e = unit(np.random.default_rng(12).normal(size=(200, 8)))
    rows, _, _ = frames(spark, e)
    one, cut = ({(r.q, r.label): (r.n, round(r.total, 9), round(r.best, 9)) for r in R.class_scores(rows, rows, block=b).collect()} for b in (2048, 3))
    assert one == cut and len(one) == 200 * 7


def test_equal_similarities_go_by_id():
    sims = np.array([[0.5, 0.9, 0.5, 0.5, -np.inf], [0.1, 0.1, 0.1, 0.1, 0.1]])
    r, c = N.best_of(sims, np.array([9, 8, 3, 5, 1]), 3)
    assert r.tolist() == [0, 0, 0, 1, 1, 1] and c.tolist() == [1, 2, 3, 4, 2, 3]


@pytest.mark.parametrize("cell_rows", [1 << 17, 60])
def test_hamming_cells_equal_all_pairs(spark, cell_rows):
    rng = np.random.default_rng(13)
    base = rng.integers(0, 1 << 56, 40)
    hashes = [int(b) ^ sum(1 << int(i) for i in rng.choice(56, rng.integers(0, 15), replace=False)) for b in np.repeat(base, 8)] + [7] * 60 + [-1, -2]
    rows = spark.createDataFrame([(1000 - k, h) for k, h in enumerate(hashes)] + [(5000, None)], "id long, h long").repartition(3)
    got = [tuple(r) for r in D.hamming_pairs(rows, "id", "h", 12, cell_rows).collect()]
    want = {(1000 - k, 1000 - j, (a ^ b) & (1 << 64) - 1) for k, a in enumerate(hashes) for j, b in enumerate(hashes[:k])}
    assert sorted(got) == sorted((a, b, x.bit_count()) for a, b, x in want if x.bit_count() <= 12)
    assert D.hamming_pairs(rows.limit(0), "id", "h", 12).isEmpty()


def test_hamming_copies_of_a_row(spark):
    """A row goes once to each cell, also where all hashes are alike; and cells are even."""
    rows = spark.range(2000).selectExpr("id as a", "7L as h")
    dealt = D.cells(rows, 250)
    assert dealt.count() == 8 * 2000 and dealt.groupBy("_i", "_j").count().agg({"count": "max"}).first()[0] < 2 * 330
    assert set(dealt.columns) == {"a", "h", "_c", "_i", "_j"}


@pytest.mark.parametrize("cell_rows", [1 << 17, 60])
def test_hamming_pairs_with_correlation(spark, monkeypatch, cell_rows):
    """The vectors go along with the hashes: each pair has the correlation that was worked out after two joins before. Hits leave in batches."""
    monkeypatch.setattr(D, "HITS", 50)
    rng = np.random.default_rng(14)
    e = np.repeat(rng.normal(size=(60, 64)), 4, axis=0) + rng.normal(size=(240, 64)) * 0.05
    vectors = [*e.tolist(), [1.0] * 64, [1.0] * 64, [2.0] * 63, [None] + [1.0] * 63, None]
    rows = spark.createDataFrame([(k, v, 7 if k >= 240 else None) for k, v in enumerate(vectors)], "id long, e array<double>, odd long").withColumn("h", F.coalesce("odd", D.difference_hash(F.col("e"), 8))).repartition(3)
    got = {(r.a, r.b): (r.distance, r.corr) for r in D.hamming_pairs(rows, "id", "h", 12, cell_rows, vector="e").collect()}
    assert {k: v[0] for k, v in got.items()} == {(r.a, r.b): r.distance for r in D.hamming_pairs(rows, "id", "h", 12, cell_rows).collect()} and len(got) > 300
    near = {k: v[1] for k, v in got.items() if k[1] < 240}
    want = np.corrcoef(e)
    assert all(abs(c - want[k]) < 1e-9 for k, c in near.items())
    assert np.isnan(got[240, 241][1]) and {got[k][1] for k in ((240, 242), (242, 243), (240, 243), (240, 244), (243, 244))} == {None}
    pairs = spark.createDataFrame(list(near), "a long, b long")
    for side in "ab":
        pairs = pairs.join(rows.select(F.col("id").alias(side), F.col("e").alias(f"e{side}")), side)
    assert all(abs(r.c - near[r.a, r.b]) < 1e-9 for r in pairs.select("a", "b", D.correlation(F.col("ea"), F.col("eb")).alias("c")).collect())


def test_hamming_cells_give_all_cores_work(spark):
    """Rows that fit one cell were one task."""
    rows = spark.range(30_000).selectExpr("id", "hash(id) * 3000000007 as h")
    pairs = D.hamming_pairs(rows, "id", "h", 0)
    assert pairs.rdd.getNumPartitions() >= 10 and pairs.count() == 0


def test_copies_are_not_compared_for_components(spark, tmp_path):
    """A hundred copies of a vector are 99 links to the first of them, where they were 4,950 pairs."""
    rng = np.random.default_rng(15)
    base = rng.normal(size=(3, 64)).astype(np.float32)
    rows = [(k, base[k % 2].tolist(), 0) for k in range(1, 200)] + [(300, base[2].tolist(), 0), (301, None, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    met = []
    hamming_pairs = D.hamming_pairs
    with pytest.MonkeyPatch.context() as m:
        m.setattr(D, "hamming_pairs", lambda rows, *a, **b: met.append(rows.count()) or hamming_pairs(rows, *a, **b))
        blocks = {r.vec_id: r.block for r in QUERIES["q_components"](spark, str(tmp_path)).collect()}
    assert met == [5]  # three vectors and the twins of two of them
    want = {k: 2 - k % 2 for k in range(1, 200)} | {300: 300, 301: 301}
    want |= {1000000 + k: want[k] for k in (*range(10, 200, 10), 300)}
    assert blocks == want
