"""Blocks, ranks over buckets, Hamming bands, the merging guard and the union chain, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from embergrid.functions import text as T
from embergrid.operators import dedup as D
from embergrid.operators import ranking
from embergrid.operators import retrieval as R
from embergrid.operators import similarity as S
from embergrid.plans import QUERIES, fixtures


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(rng.integers(0, 3)), k // 2, int(rng.integers(1, 4)), (lambda e: (e / np.sqrt(e @ e)).tolist())(rng.normal(size=4))) for k in range(40)]
    return spark.createDataFrame(rows, "vec_id long, label long, unit long, mask long, e array<double>").withColumn("scale", F.lit(0.1)).cache()


def same(a, b):
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    return sorted(map(key, a.select(*b.columns).collect())) == sorted(map(key, b.collect()))


def test_blocks_give_what_one_block_gives(vectors):
    for other_unit in (False, True):
        assert same(R.class_scores(vectors, vectors, (0, 1), other_unit=other_unit), R.class_scores(vectors, vectors, (0, 1), other_unit=other_unit, block=7))
        assert same(R.nearest(vectors, vectors, 3, (0, 1), other_unit=other_unit), R.nearest(vectors, vectors, 3, (0, 1), other_unit=other_unit, block=7))
    for kind in ("csls", "local"):
        assert same(R.scaled_exemplar(vectors, vectors, kind), R.scaled_exemplar(vectors, vectors, kind, block=7))
    assert same(R.farthest(vectors, vectors), R.farthest(vectors, vectors, block=7))
    assert R.nearest(vectors.limit(0), vectors, 3).isEmpty() and R.nearest(vectors, vectors.limit(0), 3, block=7).isEmpty()


def test_numbered_is_the_whole_order(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 2)), k, float(rng.choice([0.0, 1.0, -0.5, 1.5, *rng.random(30)]))) for k in range(300)]
    df = spark.createDataFrame(rows, "seed int, q long, v double")
    got = {(r.seed, r.q): (r["rank"], r.n, round(r.total, 9)) for r in ranking.numbered(df, ["seed"], ranking.by_share(F.col("v")), [F.col("v"), F.col("q")], {"total": F.col("v")}).collect()}
    for s in (0, 1):
        mine = sorted((v, q) for seed, q, v in rows if seed == s)
        for k, (_, q) in enumerate(mine):
            assert got[s, q] == (k + 1, len(mine), round(math.fsum(v for v, _ in mine[: k + 1]), 9))
    assert ranking.numbered(df.limit(0), ["seed"], ranking.by_share(F.col("v")), [F.col("v")]).isEmpty()


def test_hamming_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 56, 12)]
    hashes = base + [b ^ sum(1 << int(i) for i in rng.choice(56, rng.integers(0, 16), replace=False)) for b in base for _ in range(4)]
    got = {(r.a, r.b, r.distance) for r in D.hamming_pairs(spark.createDataFrame(list(enumerate(hashes)), "k long, h long"), "k", "h", 12).collect()}
    assert got == {(a, b, (x ^ y).bit_count()) for a, x in enumerate(hashes) for b, y in enumerate(hashes) if a < b and (x ^ y).bit_count() <= 12}


def test_guard():
    keep, cut = frozenset(T.DIRECTIONS + T.LATERALITY), frozenset(T.CATEGORIES)
    real = {"radial", "ulnar", "nerve", "artery", "left", "right"}
    ask = lambda a, b: S.mergeable(a, b, real, keep, cut)
    assert ask("radlal nerve", "radial nerve") and ask("radial nerve", "radial") and ask("xq radial", "radial")
    assert not ask("left radial nerve", "radial nerve") and not ask("ulnar nerve", "radial nerve") and not ask("radial iv", "radial")
    rng = np.random.default_rng(4)
    for _ in range(50):
        alike = rng.random((rng.integers(0, 5), rng.integers(0, 5))) < 0.4
        mate = S.pairing(alike)
        used = mate[mate >= 0].tolist()
        assert len(set(used)) == len(used) and all(alike[r, c] for r, c in enumerate(mate.tolist()) if c >= 0)
        assert not any(alike[r, c] for r in np.flatnonzero(mate < 0) for c in range(alike.shape[1]) if c not in used)


def test_union_chain_equals_a_loop(spark, data):
    pins = [r.asDict() for r in fixtures.pins(spark, data).collect()]
    for r in pins:
        r["w"], r["h"] = 320 + 64 * (r["image"] % 5), 240 + 48 * (r["image"] % 5)
    kept = []
    for page in {r["page"] for r in pins}:
        mine = sorted((r for r in pins if r["page"] == page), key=lambda r: r["obs_id"])
        best = min(mine, key=lambda r: (r["src"] != "src1", -r["w"] * r["h"], r["image"]))
        met = []
        for r in mine:
            x, y = round(r["x"] * (best["w"] / r["w"])), round(r["y"] * (best["h"] / r["h"]))
            if not any(k[0] == r["label"] and abs(k[1] - x) < 60 and abs(k[2] - y) < 60 for k in met):
                met.append((r["label"], x, y))
                kept.append((r["obs_id"], x, y))
    assert sorted((r.obs_id, r.x, r.y) for r in QUERIES["q_union_dedup"](spark, data).collect()) == sorted(kept)


def test_text_backend(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, prompt string")
    assert {r.reply for r in T.replies(rows, "prompt").collect()} == {"ANSWER: none CONF: 0.0"}
    own = T.replies(rows, "prompt", lambda p: p.fillna("").str.upper())
    assert sorted((r.k, r.reply) for r in own.collect()) == [(1, "A"), (2, "")]


def test_answers_that_cannot_be_read_and_unknown_keys(spark):
    from embergrid.sources import records as S

    log = spark.createDataFrame([('[{"id": 1, "answer": 5}, {"id": 2}]',), ("not json",), ("[]",), ('[{"id": 9, "answer": 1}, {"answer": 2}]',), (None,)], "value string")
    manifest = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "id long, lang string")
    assert sorted(tuple(r) for r in S.answered(log, manifest, "id bigint, answer int").collect()) == [(1, 5, "a"), (2, None, "b")]


def test_both_ways(spark):
    from embergrid.operators import spatial as G

    pairs = spark.createDataFrame([(7, 1, 2)], "image long, a int, b int")
    assert sorted(tuple(r) for r in G.both_ways(pairs).collect()) == [(7, 1, 2, "surrounds"), (7, 2, 1, "inside")]
    assert G.both_ways(pairs.limit(0)).isEmpty()


def test_fix_keeps_drops_and_replaces(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4), ("d", 5)], "label string, _to int")
    fixes = spark.createDataFrame([("a", "z"), ("a", "y"), ("b", None), ("d", None), ("d", "e"), ("x", "w")], "from string, to string")
    assert sorted((r.label or "", r._to) for r in T.fix(rows, "label", fixes).collect()) == [("", 4), ("c", 3), ("e", 5), ("y", 1)]
    assert T.fix(rows.limit(0), "label", fixes).isEmpty() and T.fix(rows, "label", fixes.limit(0)).count() == 5
