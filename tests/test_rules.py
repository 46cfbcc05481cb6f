"""Rules that must hold, worked out by hand or by a plain loop."""

import difflib
import json

import numpy as np
from pyspark.sql import functions as F

from embergrid.functions import text as T
from embergrid.functions import vectors as V
from embergrid.operators import calibration as C
from embergrid.operators import components as CC
from embergrid.operators import dedup as D
from embergrid.operators import metrics as M
from embergrid.operators import retrieval as R
from embergrid.operators import similarity as S
from embergrid.operators import spatial as G
from embergrid.operators import splits as P
from embergrid.plans import fixtures as X
from embergrid.sources import records as IO
from embergrid.streaming import streams


def test_flagship_value(spark):
    row = __import__("embergrid.plans", fromlist=["QUERIES"]).QUERIES["q_exemplar_top1"](spark, "/root/testdata/sf0.001").first()
    assert (row.top1_mean, row.top1_std) == (7.533, 1.035)


def test_ties_go_to_the_smallest_label(spark):
    df = spark.createDataFrame([(0, 1, 7, 0.5), (0, 1, 3, 0.5), (0, 1, 9, 0.4)], "seed int, q long, label long, score double")
    assert [(r.label, r["rank"]) for r in R.ranked(df).orderBy("rank").collect()] == [(3, 1), (7, 2), (9, 3)]


def test_half_even_counts(spark):
    df = spark.createDataFrame([(5,), (15,), (1,)], "n int")
    assert [r[0] for r in df.select(P.n_test(F.col("n"), 0.5)).collect()] == [2, 8, 1]


def test_no_unit_on_both_sides(spark, data):
    split = P.grouped_split(X.raw_vectors(spark, data), "unit", 0.3, [0, 1])
    assert split.groupBy("seed", "unit").agg(F.countDistinct("is_test").alias("n")).where("n > 1").isEmpty()
    assert split.where("is_test").groupBy("seed").count().select("count").distinct().collect()[0][0] == 30


def test_ece_bins(spark):
    df = spark.createDataFrame([(0, 1, 0.0, True), (0, 2, 0.1, False), (0, 3, 1.0, True)], "seed int, q long, conf double, correct boolean")
    closed, left_open = C.ece(df, 10).first().ece, C.ece(df, 10, first_closed=False).first().ece
    assert abs(closed - (abs(0.5 - 0.05) * 2 + 0.0) / 3) < 1e-9  # 0 and 0.1 share the first bin
    assert abs(left_open - 0.1 / 3) < 1e-9  # conf = 0 is in no bin


def test_auroc_ordinal_ranks(spark):
    df = spark.createDataFrame([(0, 1, 0.5, True), (0, 2, 0.5, False), (0, 3, 0.9, True), (0, 4, 0.1, False)], "seed int, q long, score double, positive boolean")
    assert C.auroc(df).first().auroc == (2 + 4 - 3) / 4
    assert C.auroc(df.where("positive")).first().auroc is None


def test_conformal_quantile(spark):
    n = 19
    df = spark.createDataFrame([(0, i, 1 - i / 100) for i in range(n)], "seed int, q long, p_true double")
    level = min(1.0, np.ceil((n + 1) * 0.9) / n)
    assert abs(C.conformal_threshold(df).first().qhat - np.quantile([i / 100 for i in range(n)], level, method="higher")) < 1e-9


def test_nan_is_skipped(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    row = M.mean_std(df, ["v"]).first()
    assert (row.v_mean, row.v_std) == (2.0, 1.0)


def test_blocks_equal_numpy(spark, data):
    rows = X.signal_vectors(spark, data).withColumn("mask", F.lit(1))
    pdf = rows.select("vec_id", "label", "e").toPandas()
    e, label, ids = np.stack(pdf["e"]), pdf["label"].to_numpy(), pdf["vec_id"].to_numpy()
    sims = e @ e.T
    np.fill_diagonal(sims, -np.inf)
    got = {(r.q, r.label): r.best for r in R.class_scores(rows, rows, block=100).collect()}
    for i in range(0, len(ids), 37):
        for c in np.unique(label):
            assert abs(got[ids[i], c] - sims[i][label == c].max()) < 1e-9
    near = R.nearest(rows.where("vec_id % 50 = 0"), rows, 3, block=4).collect()
    for r in near:
        i = int(np.flatnonzero(ids == r.q)[0])
        assert ids[np.argsort(-sims[i], kind="stable")[r["rank"] - 1]] == r.g


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in CC.components(links).collect()}
    want = {i: 0 for i in range(31)} | {100: 100, 101: 100}
    assert got == want
    assert {r.node: r.label for r in CC.components(links, edges_a_task=4).collect()} == want
    assert {r.node: r.label for r in CC._rounds(links).collect()} == want


def test_greedy_points_equals_loop(spark, data):
    rows = X.pins(spark, data)
    kept: dict = {}
    for r in rows.orderBy("obs_id").collect():
        group = kept.setdefault((r.page, r.label), [])
        if not any(abs(k.x - r.x) < 250 and abs(k.y - r.y) < 250 for k in group):
            group.append(r)
    want = {r.obs_id for g in kept.values() for r in g}
    assert {r.obs_id for r in D.greedy_points(rows, ["page", "label"], ["obs_id"], 250).collect()} == want


def test_ratios():
    assert S.indel_ratio("abcd", "abxd") == 75.0
    assert S.indel_ratio("", "") == 100.0
    assert S.sorted_ratio("left iliac artery", "artery iliac left") == 100.0


def test_near_duplicates_equal_all_pairs(spark):
    names = ["iliac artery", "illiac artery", "iliac arteryx", "femoral nerve", "femral nerve", "femoral nerv"]
    df = spark.createDataFrame([(n,) for n in names], "label string")
    got = {(r.a, r.b) for r in S.near_duplicates(df, ("artery", "nerve")).collect()}
    want = set()
    for a in names:
        for b in names:
            share = ({t for t in a.split()} & {t for t in b.split()}) - {"artery", "nerve"}
            if a < b and share and difflib.SequenceMatcher(None, a, b).ratio() >= 0.86:
                want.add((a, b))
    assert got == want


def test_canonicalise_equals_loop(spark):
    counts = {"common iliac artery": 9, "common iliac arteri": 3, "comon iliac artery": 2, "femoral nerve": 8, "femoral nerv": 1, "left ulnar nerve": 4, "right ulnar nerve": 4, "comon iliac arteri": 1, "xy": 1}
    df = spark.createDataFrame(list(counts.items()), "label string, n long")
    got = {r.label: r.canonical for r in S.canonicalise(df, valid=lambda c: F.length(c) >= 4).collect()}
    tokens: dict = {}
    for k in counts:
        if len(k) >= 4:
            for t in set(k.split()):
                tokens[t] = tokens.get(t, 0) + 1
    real = {t for t, n in tokens.items() if n >= 2}
    centres, want = [], {}
    for lab in sorted(counts, key=lambda k: (-counts[k], k)):
        if len(lab) < 4:
            want[lab] = ""
            continue
        best = max(((f(lab, c), -i, c) for f in (S.sorted_ratio, S.indel_ratio) for i, c in enumerate(centres)), default=None)
        if best and best[0] >= 90 and S.mergeable(lab, best[2], real, frozenset(T.DIRECTIONS + T.LATERALITY), frozenset(T.CATEGORIES)):
            want[lab] = best[2]
        else:
            centres.append(lab)
            want[lab] = lab
    assert got == want and got["femoral nerv"] == "femoral nerve"


def test_free_text(spark):
    df = spark.createDataFrame([("the iliac artery", "iliac artery"), ("illiac artery", "iliac artery"), ("", "x"), (None, "x"), ("nerve", "iliac artery")], "free string, true string")
    assert [r.correct for r in S.free_text_correct(df, "free", "true").collect()] == [True, True, False, False, False]


def test_hull_and_holes(spark):
    assert G.hull_area([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)]) == 4.0
    assert G.hull_area([(0, 0), (1, 1), (2, 2)]) == 0.0
    cells = [(1, r, c, 1 if (r in (1, 5) or c in (1, 5)) and 1 <= r <= 5 and 1 <= c <= 5 else 2 if (r, c) == (3, 3) else 0) for r in range(7) for c in range(7)]
    df = spark.createDataFrame(cells, "image long, r int, c int, lab int")
    assert [(r.a, r.b) for r in G.surrounds(df).collect()] == [(1, 2)]


def test_serialise_and_prompt(spark):
    df = spark.createDataFrame([("a", [(1, "deep to", ["y", "x", "y"])], ["p", "q"])], "s string, r array<struct<rel:int,phrase:string,names:array<string>>>, c array<string>")
    text = df.select(T.sentences(F.col("s"), F.col("r")).alias("t"), T.prompt(F.lit("z"), F.col("c")).alias("p")).first()
    assert text.t == "It lies on: a.\nIt is deep to x, y."
    assert "1. p\n2. q" in text.p and text.p.endswith("CONF: <confidence 0-1>")


def test_records_and_manifest(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text(json.dumps({"image": "a", "q": [3, 4], "label": "x", "page": "1"}) + "\n\n" + json.dumps({"image": "b", "q": [5, 6], "label": "y"}) + "\n")
    rows = IO.read_records(spark, str(path), "src")
    assert sorted((r.image, r.x, r.y, r.source) for r in rows.collect()) == [("a", 3, 4, "src"), ("b", 5, 6, "src")]
    found = spark.createDataFrame([("1", "u"), ("1", "v"), ("2", "w")], "file_id string, source_url string")
    target = str(tmp_path / "manifest")
    assert IO.append_manifest(spark, target, found) == 2
    assert IO.append_manifest(spark, target, found) == 0
    assert spark.read.parquet(target).count() == 2
    sealed = IO.write_once(found, str(tmp_path / "sealed"))
    assert IO.write_once(found.limit(0), str(tmp_path / "sealed")).count() == sealed.count() == 3


def test_metric_files(spark, tmp_path):
    for k in (3, 12):
        (tmp_path / f"{k:03d}-x").mkdir()
        (tmp_path / f"{k:03d}-x" / "metrics.json").write_text('{"a": 1}')
    index = IO.read_metric_files(spark, str(tmp_path) + "/*/metrics.json")
    assert sorted(r.number for r in index.collect()) == [3, 12]
    assert IO.next_number(index).first().next == 13


def test_ingest_stream_equals_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame([(str(i), k) for i in range(k, k + 3)], "file_id string, n int").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("file_id string, n int").option("maxFilesPerTrigger", 1).parquet(source)
    streams.ingest(stream, target, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.file_id for r in spark.read.parquet(target).collect()) == ["0", "1", "2", "3", "4"]


def test_answer_stream_equals_batch(spark, data, tmp_path):
    rows = X.signal_vectors(spark, data)
    asked = rows.where("vec_id % 100 = 0")
    asked.write.parquet(str(tmp_path / "q"))
    got: list = []
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "q"))
    streams.answer_stream(stream, rows, lambda df, _: got.extend(df.collect()), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.q, r.pred) for r in got) == sorted((r.q, r.pred) for r in streams.answer(asked, rows).collect())


def test_running_accuracy_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4).alias("category"), (F.col("event_type") != "error").alias("correct"))
    events.write.parquet(str(tmp_path / "e"))
    stream = streams.running_accuracy(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    stream.writeStream.format("memory").queryName("acc").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    key = lambda r: (r.day, r.category, r.n, round(r.accuracy, 9))
    assert sorted(map(key, spark.table("acc").collect())) == sorted(map(key, streams.running_accuracy(events).collect()))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<double>, b array<double>")
    row = df.select(V.unit(F.col("a")).alias("u"), V.squared_distance(F.col("a"), F.col("b")).alias("d"), V.project(F.col("a"), F.array(F.col("b"), F.col("a"))).alias("p")).first()
    assert np.allclose(row.u, [0.6, 0.8]) and row.d == 20.0 and row.p == [3.0, 25.0]


def test_transforms_equal_numpy(spark, data):
    from embergrid.operators import transforms as TR

    rows = X.signal_vectors(spark, data)
    x = np.stack(rows.orderBy("vec_id").toPandas()["e"])
    unit = lambda z: z / (np.linalg.norm(z, axis=1, keepdims=True) + 1e-9)
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    want = {"mean-centre": unit(c), "all-but-top-3": unit(c - c @ vt[:3].T @ vt[:3])}
    white = unit(c @ vt[:16].T / (s[:16] / np.sqrt(len(x)) + 1e-6))
    for name, fit in TR.FITTERS.items():
        got = np.stack(fit(rows).transform(rows).orderBy("vec_id").toPandas()["e"])
        if name in want:
            assert np.allclose(got, want[name], atol=1e-6)
        else:
            assert np.allclose(np.abs(got), np.abs(white), atol=1e-5)


def test_multi_prototype_equals_loop(spark, data):
    import hashlib

    from embergrid.operators import clusters as K

    rows = X.signal_vectors(spark, data).where("label < 2")
    got = {(r.label, r.cluster): np.array(r.centre) for r in K.prototypes(rows.select("vec_id", "label", "e"), X.DIMS, rounds=4).collect()}
    pdf = rows.toPandas()
    for label, g in pdf.groupby("label"):
        g = g.assign(o=[hashlib.md5(str(i).encode()).hexdigest() for i in g.vec_id]).sort_values("o")
        e = np.stack(g.e)
        centre = e[:3].copy()
        for _ in range(4):
            near = (e @ centre.T).argmax(1)
            for k in range(3):
                if (near == k).any():
                    m = e[near == k].mean(0)
                    centre[k] = m / (np.linalg.norm(m) + 1e-9)
        for k in range(3):
            assert np.allclose(got[label, k], centre[k], atol=1e-9)


def test_reciprocal_weights_equal_matrix_form(spark):
    from embergrid.operators import clusters as K

    rng = np.random.default_rng(7)
    n, k1, k2 = 24, 6, 3
    d = rng.random((n, n))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    order = np.argsort(d, axis=1)
    weights = np.zeros((n, n))
    def mutual(i, k):
        return {int(j) for j in order[i, : k + 1] if i in order[j, : k + 1]}
    for i in range(n):
        own = mutual(i, k1)
        grown = set(own)
        for j in own:
            theirs = mutual(j, round(k1 / 2))
            if len(theirs & own) > 2 / 3 * len(theirs):
                grown |= theirs
        for j in grown:
            weights[i, j] = np.exp(-d[i, j])
        weights[i] /= weights[i].sum()
    want = np.stack([weights[order[i, :k2]].mean(0) for i in range(n)])
    near = spark.createDataFrame([(i, int(j), r, float(d[i, j])) for i in range(n) for r, j in enumerate(order[i])], "i long, j long, rank int, d double")
    got = np.zeros((n, n))
    for r in K.reciprocal_weights(near, k1, k2).collect():
        got[r.i, r.j] = r.w
    assert np.allclose(got, want)


def test_k_reciprocal_query_equals_matrix_form(spark):
    from embergrid.plans import QUERIES

    data, k1, k2, lam = "/root/testdata/sf0.001", 10, 3, 0.3
    pdf = X.signal_vectors(spark, data).orderBy("vec_id").toPandas()
    ids, e = pdf.vec_id.to_numpy(), np.stack(pdf.e)
    d = 1 - e @ e.T
    d = d / (d.max(0) + 1e-12)
    np.fill_diagonal(d, 0)
    n, order = len(d), np.argsort(d, axis=1, kind="stable")
    assert n > 25
    def mutual(i, k):
        return {int(j) for j in order[i, : k + 1] if i in order[j, : k + 1]}
    weights = np.zeros((n, n))
    for i in range(n):
        own = mutual(i, k1)
        grown = set(own)
        for j in own:
            theirs = mutual(j, round(k1 / 2))
            if len(theirs & own) > 2 / 3 * len(theirs):
                grown |= theirs
        at = sorted(grown)
        weights[i, at] = np.exp(-d[i, at]) / np.exp(-d[i, at]).sum()
    weights = np.stack([weights[order[i, :k2]].mean(0) for i in range(n)])
    got = {(r.q, r["rank"]): (r.g, r.d) for r in QUERIES["q_k_reciprocal"](spark, data).collect()}
    asked = np.flatnonzero(ids % 50 == 0)
    assert len(got) == 10 * len(asked)
    for i in asked:
        s = np.minimum(weights[i], weights).sum(1)
        final = (1 - lam) * (1 - s / (2 - s + 1e-12)) + lam * d[i]
        final[i] = np.inf
        best = np.argsort(final, kind="stable")[:10]
        assert [got[ids[i], k + 1][0] for k in range(10)] == ids[best].tolist()
        assert np.allclose([got[ids[i], k + 1][1] for k in range(10)], final[best], atol=2e-6)
