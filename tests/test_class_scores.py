"""Class scores of many seeds in one pass, against a plain loop over all pairs."""

import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from embergrid.operators import retrieval as R
from embergrid.plans import QUERIES
from embergrid.plans import fixtures as X


def looped(rows, seeds, tau, h):
    """{(seed, q, label): (best, total, n, soft, kernel)} by one pair after the other."""
    out = {}
    for q in rows:
        for g in rows:
            for s in seeds:
                if q["id"] != g["id"] and q["asks"] >> s & 1 and g["answers"] >> s & 1:
                    x = float(np.dot(q["e"], g["e"]))
                    b, t, n, a, k = out.get((s, q["id"], g["label"]), (-np.inf, 0.0, 0, 0.0, 0.0))
                    out[s, q["id"], g["label"]] = (max(b, x), t + x, n + 1, a + np.exp(x / tau), k + np.exp((x - 1) / (h * h)))
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_equal_to_a_loop(spark, block):
    rng = np.random.default_rng(5)
    seeds = (0, 2, 5, 9)
    rows = []
    for k in range(120):
        e = rng.normal(size=3)
        answers = int(rng.integers(0, 1024)) if k % 3 else 1 << 9  # seed 9 is often the only one, and seed 5 is rare
        answers = answers | 1 << 5 if k % 40 == 7 else answers & ~(1 << 5)
        rows.append({"id": k, "label": int(rng.integers(0, 4)), "asks": int(rng.integers(0, 1024)), "answers": answers, "e": (e / np.sqrt(e @ e)).tolist()})
    for k in (10, 11, 12):
        rows[k]["e"] = rows[9]["e"]  # copies
    table = lambda mask: spark.createDataFrame([(r["id"], r["label"], r["id"] // 5, r[mask], r["e"]) for r in rows], "vec_id long, label long, unit long, mask long, e array<double>")
    want = looped(rows, seeds, 0.1, 0.3)
    scores = R.class_scores(table("asks"), table("answers"), seeds, block=block)
    got = {(r.seed, r.q, r.label): (r.best, r.total, r.n, r.soft, r.kernel) for r in scores.collect()}
    assert got.keys() == want.keys()
    for key, x in want.items():
        assert np.allclose(got[key], x, rtol=1e-9, atol=1e-9), key
    best = R.class_scores(table("asks"), table("answers"), seeds, block=block, stats=("best",))
    assert best.columns == ["seed", "q", "label", "best"]
    assert {(r.seed, r.q, r.label): round(r.best, 9) for r in best.collect()} == {k: round(x[0], 9) for k, x in want.items()}


def test_a_vector_without_numbers_spoils_only_its_own_class_and_seeds(spark):
    rows = [(0, 0, 0, 3, [1.0, 0.0]), (1, 0, 1, 1, [float("nan"), 0.0]), (2, 0, 2, 3, [0.6, 0.8]), (3, 1, 3, 3, [0.8, 0.6])]
    table = spark.createDataFrame(rows, "vec_id long, label long, unit long, mask long, e array<double>")
    got = {(r.seed, r.label): (r.best, r.total, r.kernel) for r in R.class_scores(table.where("vec_id = 0"), table, (0, 1)).collect()}
    assert all(np.isnan(x) for x in got[0, 0]) and not any(np.isnan(x) for k in ((0, 1), (1, 0), (1, 1)) for x in got[k])


@pytest.mark.parametrize("kind", ["csls", "local"])
def test_scales_of_one_table_on_both_sides(spark, data, kind):
    """More queries than a block, with scales that come from the same join: the two sides' columns were ambiguous."""
    rows = X.signal_vectors(spark, data).where("vec_id < 120").withColumn("mask", F.lit(1))
    scales = R.local_scale(R.nearest(rows, rows, 5), 5)
    asked, gallery = R.with_scales(rows.where("vec_id % 3 = 0"), scales), R.with_scales(rows, scales)
    few, many = ({(r.q, r.label): round(r.score, 9) for r in R.scaled_exemplar(asked, gallery, kind, block=b).collect()} for b in (2048, 10))
    assert few and few == many


@pytest.mark.parametrize("block", [2048, 16])
def test_nearest_row_of_each_seed(spark, block):
    """Rows of one seed each meet the rows of that seed alone (each query met every seed's rows before), and 32 bits do not decide."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(150):
        e = rng.normal(size=3) if k % 5 else np.array([1.0, 2.0, 2.0]) + rng.normal(size=3) * 1e-9  # closer to each other than 32 bits tell
        rows.append({"id": k, "label": k % 7, "asks": 1 << int(rng.integers(0, 10)), "answers": 1 << int(rng.integers(0, 10)), "e": e / np.sqrt(e @ e)})
    for k in range(40, 60):
        rows[k]["e"] = rows[40]["e"]  # copies: the first one is named
    table = lambda mask: spark.createDataFrame([(r["id"], r["label"], r["id"] // 5, r[mask], r["e"].tolist()) for r in rows], "vec_id long, label long, unit long, mask long, e array<double>")
    want = {}
    for q in rows:
        for s in range(10):
            some = [(-float(np.einsum("i,i", q["e"], g["e"])), g["id"], g["label"]) for g in rows if g["id"] != q["id"] and q["asks"] >> s & 1 and g["answers"] >> s & 1]
            if some:
                want[s, q["id"]] = min(some)
    seeds = tuple(range(10))
    near = R.nearest(table("asks"), table("answers"), 1, seeds, block=block)
    assert block > len(rows) or "[_s#" in near._jdf.queryExecution().toString()  # dealt out by seed
    got = {(r.seed, r.q): (r.g, r.label, r.sim) for r in near.collect()}
    assert got.keys() == want.keys()
    for key, (sim, g, label) in want.items():
        assert abs(got[key][2] + sim) < 1e-15 and (got[key][:2] == (g, label) or abs(want[key][0] - sim) < 1e-15), key


@pytest.mark.parametrize("stats", [("best",), ("best", "total", "n"), tuple(R.STATS)])
def test_32_bits_do_not_decide(stats, monkeypatch):
    """Entries that 32 bits cannot tell apart, copies and far larger vectors: results are those of 64 bits, and no search works through all of them in 64 bits (all did before)."""
    if "kernel" not in stats:  # which needs all products in 64 bits
        monkeypatch.setattr(R, "_raise_best", lambda *_: pytest.fail("all products in 64 bits"))
    rng = np.random.default_rng(3)
    n, seeds = 700, (0, 3, 7)
    e = rng.normal(size=(n, 8))
    e[::3] = e[0] + rng.normal(size=e[::3].shape) * 1e-9
    e[1::9] = e[1]
    e /= np.sqrt((e * e).sum(1))[:, None]
    e[5] *= 40
    label, asks, answers = rng.integers(0, 4, n), rng.integers(0, 256, n), rng.integers(0, 256, n)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 8, pa.int32()), pa.array(e.reshape(-1)))
    batch = pa.record_batch([pa.array(np.arange(n)), pa.array(label), pa.array(np.arange(n) // 5), pa.array(answers), lists], names=["vec_id", "label", "unit", "mask", "e"])
    block = SimpleNamespace(value={"q": np.arange(n), "unit": np.arange(n) // 5, "mask": asks, "e": e})
    out = pa.Table.from_batches(R._class_scores(iter([batch.slice(0, 300), batch.slice(300)]), block, seeds, 10.0, 3.0, True, stats)).to_pylist()
    sims = (e[:, None, :] * e[None]).sum(2)
    other = np.arange(n)[:, None] // 5 != np.arange(n)[None] // 5
    met = 0
    for r in out:
        x = sims[r["q"], other[r["q"]] & (label == r["label"]) & (answers >> r["seed"] & 1 > 0)]
        want = {"best": x.max(), "total": x.sum(), "n": len(x), "soft": np.exp(x / 10).sum(), "kernel": np.exp((x - 1) / 9).sum()}
        assert abs(r["best"] - want["best"]) <= 1e-14 * max(1, abs(want["best"]))
        assert all(np.isclose(r[s], want[s], rtol=1e-10, atol=1e-10) for s in stats)
        met += len(x)
    assert met == sum((other & (asks >> s & 1 > 0)[:, None] & (answers >> s & 1 > 0)[None]).sum() for s in seeds)


@pytest.mark.parametrize("block", [2048, 16])
def test_kernels_of_several_widths_are_one_pass(spark, block):
    """A pass for each width before."""
    rng = np.random.default_rng(6)
    e = rng.normal(size=(60, 3))
    e /= np.sqrt((e * e).sum(1))[:, None]
    rows = spark.createDataFrame([(k, k % 4, k // 5, 1, x.tolist()) for k, x in enumerate(e)], "vec_id long, label long, unit long, mask long, e array<double>")
    widths = (0.4, 0.15, 0.4)
    scores = R.class_scores(rows, rows, h=widths, stats=("best", "kernel"), block=block)
    assert scores.columns == ["seed", "q", "label", "best", "kernel_0", "kernel_1", "kernel_2"]
    got = {(r.q, r.label): (r.kernel_0, r.kernel_1, r.kernel_2) for r in scores.collect()}
    want = {}
    for q in range(60):
        for g in range(60):
            if q != g:
                old = want.get((q, g % 4), np.zeros(3))
                want[q, g % 4] = old + np.exp((e[q] @ e[g] - 1) / np.square(widths))
    assert got.keys() == want.keys() and all(np.allclose(got[k], x, rtol=1e-9) for k, x in want.items())


def test_bandwidth_meets_each_pair_once(spark, data):
    plan = QUERIES["q_fit_bandwidth"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InArrow") == 1  # four before


class Counted(np.ndarray):
    """Counts the entries that are picked out of rows."""

    picked = 0

    def __getitem__(self, key):
        out = super().__getitem__(key)
        if out.ndim == 2 and isinstance(key, tuple) and isinstance(key[0], np.ndarray):
            Counted.picked += out.size
        return out


@pytest.mark.parametrize("n", [1, 15, 16, 17, 31, 250, 1024, 1030])
def test_a_turn_looks_at_few_products(n):
    """A query's first turn settles it here, and looks at 16 of its products (64 before)."""
    rng = np.random.default_rng(n)
    q, e = rng.normal(size=(20, 8)), rng.normal(size=(n, 8))
    part = (q.astype(np.float32) @ e.astype(np.float32).T).view(Counted)
    held, asked, bits = np.full((20, 2), -np.inf), np.ones((20, 2), bool), np.ones((n, 2), bool)
    Counted.picked = 0
    R._raise_rounded(held, part, np.full(20, 1e-5), q, e, asked, bits)
    assert np.allclose(held, (q @ e.T).max(1)[:, None], rtol=1e-14, atol=1e-14)
    assert Counted.picked <= 20 * 16


@pytest.mark.parametrize("labels", [1, 3, 400])
def test_sums_take_pieces_of_bounded_size(labels, monkeypatch):
    """Kernels of a batch of few labels went through pieces of 512 queries with all rows of a label, too large for a core's cache."""
    rng = np.random.default_rng(labels)
    n, m = 1300, 300
    e = rng.normal(size=(n, 4))
    e /= np.sqrt((e * e).sum(1))[:, None]
    label, answers = rng.integers(0, labels, n), rng.integers(0, 4, n)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 4, pa.int32()), pa.array(e.reshape(-1)))
    batch = pa.record_batch([pa.array(np.arange(n)), pa.array(label), pa.array(np.arange(n) // 5), pa.array(answers), lists], names=["vec_id", "label", "unit", "mask", "e"])
    block = SimpleNamespace(value={"q": np.arange(m), "unit": np.arange(m) // 5, "mask": np.full(m, 3), "e": e[:m]})
    sizes, products = [], R._products
    monkeypatch.setattr(R, "_products", lambda *args: (sizes.append(x[5].size) or x for x in products(*args)))
    for other_unit in (False, True):
        out = pa.Table.from_batches(R._class_scores(iter([batch]), block, (0, 1), 0.5, (0.7, 0.9), other_unit, ("n", "soft", "kernel"))).to_pylist()
        sims, met = e[:m] @ e.T, 0
        for r in out:
            other = np.arange(n) // 5 != r["q"] // 5 if other_unit else np.arange(n) != r["q"]
            x = sims[r["q"], other & (label == r["label"]) & (answers >> r["seed"] & 1 > 0)]
            want = [len(x), np.exp(x / 0.5).sum(), *(np.exp((x - 1) / h**2).sum() for h in (0.7, 0.9))]
            assert np.allclose([r[c] for c in ("n", "soft", "kernel_0", "kernel_1")], want, rtol=1e-10)
            met += len(x)
        own = [((np.arange(n) // 5 == q // 5) if other_unit else np.arange(n) == q) for q in range(m)]
        assert met == sum(((answers >> s & 1 > 0) & ~o).sum() for s in (0, 1) for o in own)
    assert max(sizes) <= 512 * 128


@pytest.mark.parametrize("copies", [False, True])
def test_gallery_rows_are_prepared_once_a_cell(copies, monkeypatch):
    """Each tile of queries read, sorted and merged the gallery rows of its cell anew, and looked through the rows of one label in several parts."""
    rng = np.random.default_rng(4)
    n, m, seeds = 300, 64, (0, 1, 2)
    e = rng.normal(size=(n, 4))
    e[n // 2 :] = e[: n // 2] if copies else e[n // 2 :]
    label, answers, asks = np.arange(n) % (n // 2) % 3, rng.integers(0, 8, n), rng.integers(1, 8, m)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 4, pa.int32()), pa.array(x.reshape(-1)))
    queries = pa.table({"q": np.arange(m), "unit": np.arange(m) // 5, "mask": asks, "e": lists(e[:m])})
    gallery = pa.table({"vec_id": np.arange(n), "label": label, "unit": np.arange(n) // 5, "mask": answers, "e": lists(e)})
    read, looked, matrix, products = [], [], R._matrix, R._products
    monkeypatch.setattr(R, "_matrix", lambda x: read.append(len(x)) or matrix(x))
    monkeypatch.setattr(R, "_products", lambda *args: (looked.append(x[5].shape) or x for x in products(*args)))
    schema = pa.schema([("seed", pa.int32()), ("q", pa.int64()), ("label", pa.int64()), ("best", pa.float64())])
    fn = R.partial(R._class_scores, seeds=seeds, tau=0.1, h=0.3, other_unit=False, stats=("best",))
    out = R._cell(queries, gallery, fn, ["q", "unit", "mask", "e"], schema, 16, ready=R.partial(R._Rows, seeds=seeds), whole=True).to_pylist()
    assert read == [n] and len(looked) == 4 * 3  # four tiles, three labels
    other = np.arange(m)[:, None] != np.arange(n)
    want = {}
    for s in seeds:
        for c in range(3):
            ok = other & (asks >> s & 1 > 0)[:, None] & (answers >> s & 1 > 0) & (label == c)
            sims = np.where(ok, e[:m] @ e.T, -np.inf).max(1)
            want |= {(s, q, c): sims[q] for q in np.flatnonzero(sims > -np.inf).tolist()}
    got = {(r["seed"], r["q"], r["label"]): r["best"] for r in out}
    assert got.keys() == want.keys() and all(abs(got[k] - x) < 1e-13 for k, x in want.items())


def test_pairs_of_cells_have_partitions_of_their_own(spark, data):
    """All pairs went to the session's shuffle partitions (four here), which then ran several one after the other."""
    rows = X.signal_vectors(spark, data).withColumn("mask", F.lit(1))
    scores = R.class_scores(rows, rows, stats=("best",), block=16)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    parts = [int(x) for x in re.findall(r"hashpartitioning\(_q#[^)]*, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert len(parts) == 2 and parts[0] == parts[1] >= 16 * R.SPREAD  # four cells for each of four cores


@pytest.mark.parametrize("k", [1, 3])
def test_rows_of_a_seed_are_not_copied_for_each_cell(spark, monkeypatch, k):
    """Ten cells a seed on one side were ten copies of each row of the other."""
    monkeypatch.setattr(R, "TILES", 1)
    rng = np.random.default_rng(21)
    e = rng.normal(size=(300, 8))
    e[250:] = e[:50]  # ties
    rows = lambda mask: spark.createDataFrame([(i, i % 4, i, mask(i % 3), v.tolist()) for i, v in enumerate(e)], "vec_id long, label long, unit long, mask long, e array<double>").repartition(3)
    packed, seen = R._packed, []
    monkeypatch.setattr(R, "_packed", lambda *a: seen.append(packed(*a)) or seen[-1])
    near = R.nearest(rows(lambda s: 1 << s), rows(lambda s: 7 ^ 1 << s), k, (0, 1, 2), block=20)
    got = {(r.seed, r.q, r["rank"]): (r.g, r.label) for r in near.collect()}
    assert "CartesianProduct" in near._jdf.queryExecution().executedPlan().toString()
    assert [sum(pa.ipc.open_stream(bytes(r.rows)).read_all().num_rows for r in df.collect()) for df in seen] == [300, 600] and all(df.count() > 10 for df in seen)
    want = {}
    for i in range(300):
        s = i % 3
        ranked = sorted((g for g in range(300) if g % 3 != s), key=lambda g: (-round(float(e[i] @ e[g]), 9), g))[:k]
        want |= {(s, i, r + 1): (g, g % 4) for r, g in enumerate(ranked)}
    assert got == want
