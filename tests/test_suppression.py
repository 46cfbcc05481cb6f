"""Greedy suppression against a plain loop."""

import numpy as np
import pytest

from embergrid.operators import dedup as D
from embergrid.operators import suppression as S


def loop(rows, d):
    """rows: (group, order, id, x, y)."""
    kept = []
    for r in sorted(set(rows), key=lambda r: (r[1], r[3] is not None, r[3] or 0, r[4] is not None, r[4] or 0, r[2])):
        if r[3] is None or r[4] is None or not any(k[0] == r[0] and k[3] is not None and k[4] is not None and abs(k[3] - r[3]) < d and abs(k[4] - r[4]) < d for k in kept):
            kept.append(r)
    return sorted((r[2] for r in kept))


@pytest.mark.parametrize("kind", ["spread", "one spot", "sorted", "mixed"])
@pytest.mark.parametrize("fold_rows", [1000, 20])
def test_equals_the_loop(spark, kind, fold_rows):
    rng = np.random.default_rng(len(kind))
    n = 260
    x, y = (rng.uniform(-100, 400, n), rng.uniform(-100, 300, n)) if kind != "one spot" else (rng.uniform(0, 60, n), rng.uniform(0, 60, n))
    if kind == "sorted":
        x, y = np.sort(x), y * 0
    group = rng.integers(0, 3, n) if kind == "mixed" else np.zeros(n, int)
    rows = [(None if g == 2 else int(g), int(o), i, float(a), float(b)) for i, (g, o, a, b) in enumerate(zip(group, np.arange(n) if kind == "sorted" else rng.integers(0, 40, n), x, y, strict=True))]
    if kind == "mixed":
        rows += [(0, 1, 900, None, 5.0), (0, 1, 901, None, None), (None, 0, 902, 3.0, None), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "g int, o int, obs_id long, x double, y double").repartition(4)
    got = sorted(r.obs_id for r in S.greedy(df, ["g"], ["o"], 35, fold_rows=fold_rows).collect())
    assert got == loop(rows, 35)


def test_a_large_group_is_settled_in_few_rounds(spark, monkeypatch):
    """100,000 points of one group and label: rounds, not a fold, and few of them."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 640, 100_000), rng.integers(0, 480, 100_000)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"page": 1, "label": 2, "obs_id": np.arange(100_000), "x": x, "y": y}))
    rounds = []
    real = S.Scratch.drop_but_last
    monkeypatch.setattr(S.Scratch, "drop_but_last", lambda self, name: (rounds.append(name), real(self, name))[1])
    got = sorted(r.obs_id for r in D.greedy_points(df, ["page", "label"], ["obs_id"], 35).collect())
    kept: dict = {}
    want = []
    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        u, v = a // 35, b // 35
        if not any(abs(p - a) < 35 and abs(q - b) < 35 for j in (-1, 0, 1) for k in (-1, 0, 1) if (q_p := kept.get((u + j, v + k))) for p, q in [q_p]):
            kept[u, v] = a, b
            want.append(i)
    assert got == want and len(rounds) < 25


def test_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.5, "a"), (1, 2, 2.0, 2.9, 8.5, "b"), (1, 3, 3.0, 0.0, 7.5, "c")], "page int, obs_id long, x double, y double, w double, kind string")
    got = S.greedy(df, ["page"], ["obs_id"], 3, extra=("w", "kind"))
    assert got.columns == ["page", "obs_id", "x", "y", "w", "kind"]
    assert sorted((r.obs_id, r.w, r.kind) for r in got.collect()) == [(1, 9.5, "a"), (3, 7.5, "c")]
    assert S.greedy(df.limit(0), ["page"], ["obs_id"], 3).isEmpty()
