"""Scene edges, image regions, fine maps, verdicts and bootstrap draws against plain Python."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from embergrid.operators import metrics as M
from embergrid.operators import spatial as G
from embergrid.operators import splits as S

PLACES = "image long, lab int, cx double, cy double, depth double"


def test_edges_of_ties_and_depths(spark):
    regions = spark.createDataFrame([(1, 1, 1.0, 4.0, 0.5), (1, 2, 7.0, 1.0, 0.5), (1, 3, 4.0, 2.0, 0.9)], PLACES)
    pairs = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 3)], "image long, a int, b int")
    got = {(r.i, r.j, r.rel) for r in G.typed_edges(regions, pairs, 8.0).collect()}
    near = {(a, b, "adjacent") for a, b in ((1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2))}
    assert got == near | {(3, 1, "medial"), (1, 3, "lateral"), (3, 2, "medial"), (2, 3, "lateral"), (3, 1, "deep"), (3, 2, "deep")}


def test_edges_without_depth_go_by_the_centre(spark):
    regions = spark.createDataFrame([(1, 1, 1.0, 4.0, None), (1, 2, 4.0, 2.0, None), (1, 3, 7.0, 4.0, None)], PLACES)
    pairs = spark.createDataFrame([(1, 1, 2), (1, 1, 3)], "image long, a int, b int")
    deep = lambda **k: [(r.i, r.j) for r in G.typed_edges(regions, pairs, 8.0, **k).where("rel = 'deep'").collect()]
    assert deep(height=8.0) == [(2, 1)]
    assert deep() == []


def plain_clusters(rows, k, beta, rounds):
    """Lloyd's rounds in loops, from k cells evenly spaced in row-major order."""
    side = max(max(r, c) for r, c, _ in rows) + 1
    def feature(r, c, token):
        length = sum(x * x for x in token) ** 0.5
        return [x / length for x in token] + [beta * r / side, beta * c / side]
    feats = [feature(*row) for row in sorted(rows)]
    centres, labs = [feats[j * len(feats) // k] for j in range(k)], []
    for _ in range(rounds):
        labs = [min(range(k), key=lambda j: (sum((x - y) ** 2 for x, y in zip(f, centres[j], strict=True)), j)) for f in feats]
        for j in range(k):
            own = [f for f, lab in zip(feats, labs, strict=True) if lab == j]
            centres[j] = [sum(x) / len(own) for x in zip(*own, strict=True)] if own else centres[j]
    return {(r, c): lab + 1 for (r, c, _), lab in zip(sorted(rows), labs, strict=True)}


def test_clusters_of_an_image(spark):
    draw = random.Random(3)
    maps = {7: [(r, c, [draw.random() + 0.1, draw.random(), draw.random()]) for r in range(5) for c in range(6)], 5: [(r, c, [1.0, 0.0] if r < 2 else [0.0, 1.0]) for r in range(4) for c in range(4)]}
    cells = spark.createDataFrame([(k, *row) for k, rows in maps.items() for row in rows], "image long, r int, c int, token array<double>")
    got = {(r.image, r.r, r.c): r.lab for r in G.clustered(cells, 2, rounds=6).collect()}
    assert got == {(k, r, c): lab for k, rows in maps.items() for (r, c), lab in plain_clusters(rows, 2, 2.0, 6).items()}
    assert [got[5, r, 0] for r in range(4)] == [1, 1, 2, 2]
    more = G.clustered(cells.where("image = 5"), 40)  # more clusters than cells
    assert {r.lab for r in more.collect()} <= set(range(1, 17))
    assert G.clustered(cells.limit(0)).collect() == []


@pytest.mark.parametrize("n, size", [(2, 8), (3, 7), (4, 4)])
def test_fine_map(spark, n, size):
    coarse = spark.createDataFrame([(1, i, j, 10 * i + j) for i in range(n) for j in range(n)], "image long, br int, bc int, lab int")
    got = {(r.r, r.c): r.lab for r in G.upsampled(coarse, n, size).collect()}
    assert got == {(r, c): 10 * (r * n // size) + c * n // size for r in range(size) for c in range(size)}


def test_seven_wins_of_ten_are_adopted(spark):
    rows = spark.createDataFrame([(1.0, 7), (1.0, 6), (0.0, 9), (-1.0, 10)], "delta double, wins int")
    assert [r[0] for r in rows.select(M.verdict(F.col("delta"), F.col("wins"))).collect()] == ["adopt", "keep", "keep", "keep"]


def test_bootstrap_draws(spark):
    values = {k: float(k * k) for k in range(9)}
    order = sorted(values, key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    draw = lambda b, j: int(hashlib.md5(f"0|{b}|{j}".encode()).hexdigest()[:8], 16) % 9
    want = {b: sum(values[order[draw(b, j)]] for j in range(9)) / 9 for b in range(50)}
    got = S.bootstrap_means(spark.createDataFrame(list(values.items()), "q long, v double"), "q", "v", 50).collect()
    assert {r.replicate: pytest.approx(r.mean) for r in got} == want
    assert S.bootstrap_means(spark.createDataFrame([], "q long, v double"), "q", "v", 5).collect() == []

@pytest.mark.parametrize("held", [S.HELD, 10])
def test_bootstrap_draws_are_dealt_out(spark, held):
    """Few outcomes are one small partition; their draws, two thousand times as many, were made there by one task."""
    hits = {k: float(k % 3) if k % 7 else None for k in range(300)}
    rows = spark.createDataFrame(list(hits.items()), "q long, hit double").coalesce(1)
    order = sorted(hits, key=lambda k: (hashlib.md5(str(k).encode()).hexdigest(), k))
    want = {}
    for b in range(40):
        drawn = [hits[order[int(hashlib.md5(f"0|{b}|{j}".encode()).hexdigest()[:8], 16) % 300]] for j in range(300)]
        want[b] = np.mean([x for x in drawn if x is not None])
    got = {r.replicate: r.mean for r in S.bootstrap_means(rows, "q", "hit", 40, held=held).collect()}
    assert got.keys() == want.keys() and all(abs(got[b] - want[b]) < 1e-12 for b in want)
    assert S.draws(spark, 300, 40).rdd.getNumPartitions() >= 16
    assert S.bootstrap_means(rows.where("q < 0"), "q", "hit", 40, held=held).isEmpty()
    unknown = rows.withColumn("hit", F.lit(None).cast("double"))
    assert {r.mean for r in S.bootstrap_means(unknown, "q", "hit", 3, held=held).collect()} == {None}
