"""Evaluation of scorers under leak-safe splits, and search queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embergrid.functions import vectors as V
from embergrid.operators import metrics as M
from embergrid.operators import retrieval as R
from embergrid.operators import splits as S
from embergrid.sources.shared import staged

from . import fixtures as X
from .registry import query

SEEDS = 10


def _sides(vectors: DataFrame, seeds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Test queries, gallery (train rows) and the truth of the queries, by bit masks of seeds. Searches count and read both sides several times, so they are a table."""
    rows = staged(S.masks(vectors, "unit", S.grouped_split(vectors, "unit", 0.3, list(range(seeds)))), "sides")
    asked = rows.withColumn("mask", F.col("test_mask")).where("mask > 0")
    gallery = rows.withColumn("mask", F.bitwise_not("test_mask"))
    truth = asked.select(seeds_of(seeds).alias("seed"), F.col("vec_id").alias("q"), F.col("label").alias("truth"))
    return asked, gallery, truth


def seeds_of(n: int = SEEDS) -> Column:
    """One row for each seed whose bit is set in mask."""
    return F.explode(F.filter(F.array(*[F.when(F.shiftright("mask", s).bitwiseAND(1) == 1, s) for s in range(n)]), lambda x: x.isNotNull()))


def scored(spark, sf_dir, seeds: int = SEEDS, raw: bool = False, stats: tuple[str, ...] = ("best",)) -> tuple[DataFrame, DataFrame]:
    """Class scores of the test rows of each seed, of which only `stats` are worked out, and their truth. Plans read the scores several times, so they are a table."""
    vectors = (X.raw_vectors if raw else X.signal_vectors)(spark, sf_dir)
    asked, gallery, truth = _sides(vectors, seeds)
    return staged(R.class_scores(asked, gallery, tuple(range(seeds)), stats=stats), "scores"), truth


def _report(scores: DataFrame, truth: DataFrame) -> DataFrame:
    per_seed = M.accuracy(M.truth_ranks(R.ranked(scores), truth))
    return M.mean_std(per_seed, ["top1", "top3", "top5", "coverage", "end_to_end"])


def _report_sql(score: str, vectors: str, seeds: int = SEEDS, scores: str = "") -> str:
    return f"""with {vectors}, {X.scores_sql(seeds)},
{scores or f"s as (select seed, q, truth, label, {score} as score from sc)"},
r as (select *, row_number() over (partition by seed, q order by score desc, label) as rk from s),
asked as (select a.seed, q.vec_id as q, q.label as truth from split a join v q on q.unit = a.unit and a.is_test),
t as (select asked.seed, asked.q, r.rk from asked left join r on r.seed = asked.seed and r.q = asked.q and r.label = asked.truth),
p as (select seed, 100.0::double * avg((rk <= 1)::int) as top1, 100.0::double * avg((rk <= 3)::int) as top3, 100.0::double * avg((rk <= 5)::int) as top5, 100.0::double * avg((rk is not null)::int) as coverage from t group by seed),
e as (select *, top1 * coverage / 100 as end_to_end from p)
select {", ".join(f"round(avg({c}), 3) as {c}_mean, round(stddev_pop({c}), 3) as {c}_std" for c in ("top1", "top3", "top5", "coverage", "end_to_end"))} from e"""


@query(_report_sql("best", X.RAW, 10))
def q_exemplar_top1(spark, sf_dir):
    """Ten leak-safe seeds of the per-class maximum, on the vectors as given."""
    scores, truth = scored(spark, sf_dir, 10, raw=True)
    return _report(R.exemplar(scores), truth)


@query(_report_sql("best", X.SIGNAL))
def q_exemplar_signal(spark, sf_dir):
    scores, truth = scored(spark, sf_dir)
    return _report(R.exemplar(scores), truth)


@query(_report_sql("0.1 * ln(soft + 1e-9)", X.SIGNAL))
def q_lse(spark, sf_dir):
    scores, truth = scored(spark, sf_dir, stats=("soft",))
    return _report(R.log_sum_exp(scores), truth)


@query(_report_sql("kernel", X.SIGNAL))
def q_kde(spark, sf_dir):
    scores, truth = scored(spark, sf_dir, stats=("kernel",))
    return _report(R.kernel_density(scores), truth)


KNN = """nn as (select *, row_number() over (partition by seed, q order by sim desc, g) as k from sims),
s as (select seed, q, truth, label, {} as score from nn where k <= 5 group by seed, q, truth, label)"""


@query(_report_sql("", X.SIGNAL, scores=KNN.format("sum(sim)")))
def q_knn_vote(spark, sf_dir):
    asked, gallery, truth = _sides(X.signal_vectors(spark, sf_dir), SEEDS)
    return _report(R.knn_vote(R.nearest(asked, gallery, 5, tuple(range(SEEDS)))), truth)


@query(_report_sql("", X.SIGNAL, scores=KNN.format("count(*) + 1e-3 * max(sim)")))
def q_knn_majority(spark, sf_dir):
    asked, gallery, truth = _sides(X.signal_vectors(spark, sf_dir), SEEDS)
    return _report(R.knn_majority(R.nearest(asked, gallery, 5, tuple(range(SEEDS)))), truth)


MEANS = """md as (select b.seed, g.label, i, avg(g.e[i + 1]) as m from split b join v g on g.unit = b.unit and not b.is_test, range(64) d(i) group by all),
mv as (select seed, label, list(m order by i) as m from md group by seed, label),
mu as (select seed, label, m, sqrt(list_dot_product(m, m)) + 1e-9 as len from mv),
s as (select a.seed, q.vec_id as q, q.label as truth, mu.label, list_dot_product(q.e, mu.m) / len as score from split a join v q on q.unit = a.unit and a.is_test join mu on mu.seed = a.seed)"""


@query(_report_sql("", X.SIGNAL, scores=MEANS))
def q_prototype_top1(spark, sf_dir):
    asked, gallery, truth = _sides(X.signal_vectors(spark, sf_dir), SEEDS)
    per_seed = gallery.withColumn("seed", seeds_of())
    means = R.class_means(per_seed, X.DIMS, by=("seed", "label")).select(F.col("seed").cast("int").alias("seed"), "label", "mean")
    queries = truth.select("seed", F.col("q").alias("vec_id")).join(asked.select("vec_id", "e"), "vec_id")
    return _report(R.prototype(queries, F.broadcast(means), ["seed"]), truth)


# -- search: queries are the rows whose id is divisible by 50, against all rows

SEARCH = "sims as (select q.vec_id as q, q.label as truth, g.vec_id as g, g.label as label, list_dot_product(q.e, g.e) as sim from v q, v g where q.vec_id % 50 = 0 and q.vec_id <> g.vec_id)"
NEAR = SEARCH + ", nn as (select *, row_number() over (partition by q order by sim desc, g) as k from sims)"


def _search(spark, sf_dir):
    rows = X.signal_vectors(spark, sf_dir).withColumn("mask", F.lit(1))
    return rows.where(F.col("vec_id") % 50 == 0), rows


@query(f"with {X.SIGNAL}, {NEAR} select q, g, label, k::int as rank, round(sim, 6) as sim from nn where k <= 10")
def q_nearest(spark, sf_dir):
    asked, gallery = _search(spark, sf_dir)
    return R.nearest(asked, gallery, 10).select("q", "g", "label", "rank", F.round("sim", 6).alias("sim"))


@query(f"""with {X.SIGNAL}, {NEAR}, best as (select q, truth, label, max(sim) as score from sims group by all),
r as (select *, row_number() over (partition by q order by score desc, label) as rk from best)
select q, max(case when rk = 1 then label end) as top1, list(label order by rk) filter (rk <= 5) as top5, max(case when label = truth then rk end)::int as rank_true, least(coalesce(max(case when label = truth then rk end), 6), 6)::int as bucket from r group by q""")
def q_ranked_labels(spark, sf_dir):
    asked, gallery = _search(spark, sf_dir)
    ranked = R.ranked(R.exemplar(R.class_scores(asked, gallery, stats=("best",))))
    truth = asked.select(F.col("vec_id").alias("q"), F.col("label").alias("truth"))
    rows = ranked.join(truth, "q")
    hit = F.max(F.when(F.col("label") == F.col("truth"), F.col("rank")))
    return rows.groupBy("q").agg(F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("top1"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "label")))), lambda x: x["label"]).alias("top5"), hit.alias("rank_true"), F.least(F.coalesce(hit, F.lit(6)), F.lit(6)).alias("bucket"))


@query(f"""with {X.SIGNAL}, sims as (select q.vec_id as q, q.label as truth, g.label as label, list_dot_product(q.e, g.e) as sim from v q, v g where q.vec_id % 50 = 0 and q.unit <> g.unit),
b as (select q, truth, label, max(sim) as score from sims group by all), r as (select *, row_number() over (partition by q order by score desc, label) as rk from b)
select q, max(case when rk = 1 then label end) as pred, bool_or(label = truth) as covered from r group by q""")
def q_other_unit_loo(spark, sf_dir):
    """Prediction from rows of other units only."""
    asked, gallery = _search(spark, sf_dir)
    ranked = R.ranked(R.exemplar(R.class_scores(asked, gallery, other_unit=True, stats=("best",))))
    return ranked.join(asked.select(F.col("vec_id").alias("q"), F.col("label").alias("truth")), "q").groupBy("q").agg(F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("pred"), F.bool_or(F.col("label") == F.col("truth")).alias("covered"))


@query(f"""with {X.SIGNAL}, {SEARCH}, sc as (select q, label, count(*) as n, sum(exp((sim - 1) / (0.3 * 0.3))) as kernel from sims group by all),
j as (select q, label, kernel * n / sum(n) over (partition by q) as joint from sc), d as (select *, sum(joint) over (partition by q) + 1e-30 as density from j)
select q, label, round(joint / density, 6) as score, round(density, 6) as density from d""")
def q_kde_posterior(spark, sf_dir):
    asked, gallery = _search(spark, sf_dir)
    return R.kernel_posterior(R.class_scores(asked, gallery)).select("q", "label", F.round("score", 6).alias("score"), F.round("density", 6).alias("density"))


SCALES = """gg as (select a.vec_id as a, b.vec_id as b, list_dot_product(a.e, b.e) as sim from v a, v b where a.vec_id <> b.vec_id),
gk as (select a, sim, row_number() over (partition by a order by sim desc, b) as k from gg), scale as (select a as vec_id, avg(sim) as r from gk where k <= 5 group by a)"""


def _scales(spark, sf_dir):
    asked, gallery = _search(spark, sf_dir)
    scales = staged(R.local_scale(R.nearest(gallery, gallery, 5), 5), "scales")
    return R.with_scales(asked, scales), R.with_scales(gallery, scales)


def _scaled_sql(expr: str) -> str:
    return f"""with {X.SIGNAL}, {SEARCH}, {SCALES}, x as (select sims.q, sims.label, {expr} as s from sims join scale a on a.vec_id = sims.q join scale b on b.vec_id = sims.g)
select q, label, round(max(s), 6) as score from x group by all"""


@query(_scaled_sql("2 * sim - a.r - b.r"))
def q_csls(spark, sf_dir):
    return R.scaled_exemplar(*_scales(spark, sf_dir), "csls").select("q", "label", F.round("score", 6).alias("score"))


@query(_scaled_sql("sim / sqrt((a.r + 1e-6) * (b.r + 1e-6))"))
def q_local_scaling(spark, sf_dir):
    return R.scaled_exemplar(*_scales(spark, sf_dir), "local").select("q", "label", F.round("score", 6).alias("score"))


@query(f"""with {X.SIGNAL}, {NEAR}, m as (select q, i, avg(v.e[i + 1]) as m from nn join v on v.vec_id = nn.g, range(64) d(i) where k <= 3 group by q, i),
x as (select m.q, list(m.m + v.e[m.i + 1] order by m.i) as e from m join v on v.vec_id = m.q group by m.q), y as (select q, e, sqrt(list_dot_product(e, e)) + 1e-9 as len from x)
select y.q, g.label, round(max(list_dot_product(y.e, g.e) / len), 6) as score from y, v g where g.vec_id <> y.q group by all""")
def q_aqe(spark, sf_dir):
    asked, gallery = _search(spark, sf_dir)
    more = R.expanded(asked, gallery, R.nearest(asked, gallery, 3), X.DIMS, 3)
    return R.class_scores(more, gallery).select("q", "label", F.round("best", 6).alias("score"))


@query(f"""with {X.SIGNAL}, {SEARCH}, sc as (select q, label, max(sim) as a, avg(sim) as b from sims group by all) select q, label, round(a + 0.5 * b, 6) as score from sc""")
def q_score_ensemble(spark, sf_dir):
    asked, gallery = _search(spark, sf_dir)
    scores = R.class_scores(asked, gallery)
    return R.linear(R.exemplar(scores), scores.select("seed", "q", "label", (F.col("total") / F.col("n")).alias("score")), 0.5).select("q", "label", F.round("score", 6).alias("score"))


@query(f"""with {X.SIGNAL}, sims as (select q.vec_id as q, g.label, list_dot_product(q.e, g.e) as sim from v q, v g where q.vec_id % 50 = 0 and q.vec_id <> g.vec_id and q.label % 3 = g.label % 3)
select q, label, round(max(sim), 6) as score from sims group by all""")
def q_category_oracle(spark, sf_dir):
    """Retrieval restricted to the query's own category: categories take the place of seeds."""
    rows = X.signal_vectors(spark, sf_dir).withColumn("mask", S.bit(F.col("label") % 3))
    return R.class_scores(rows.where(F.col("vec_id") % 50 == 0), rows, (0, 1, 2)).select("q", "label", F.round("best", 6).alias("score"))


CENTROIDS = """md as (select label, i, avg(e[i + 1]) as m from v, range(64) d(i) group by label, i), mv as (select label, list(m order by i) as m from md group by label),
mu as (select label, m, sqrt(list_dot_product(m, m)) + 1e-9 as len from mv),
cc as (select a.label as a, b.label as b, list_dot_product(a.m, b.m) / a.len / b.len as cos from mu a join mu b on a.label < b.label)"""


def _centroids(spark, sf_dir) -> DataFrame:
    means = R.class_means(X.signal_vectors(spark, sf_dir), X.DIMS).select("label", "mean")
    b = means.select(F.col("label").alias("b"), F.col("mean").alias("other"))
    # class means: as many rows as labels
    return means.join(F.broadcast(b), F.col("label") < F.col("b")).select(F.col("label").alias("a"), "b", V.dot(F.col("mean"), F.col("other")).alias("cos"))


@query(f"with {X.SIGNAL}, {CENTROIDS} select a, b, round(cos, 6) as cos from cc")
def q_centroid_cosines(spark, sf_dir):
    return _centroids(spark, sf_dir).select("a", "b", F.round("cos", 6).alias("cos"))


@query(f"with {X.SIGNAL}, {CENTROIDS} select round(avg(case when a % 3 = b % 3 then cos end) - avg(case when a % 3 <> b % 3 then cos end), 6) as category, round(avg(case when a % 4 = b % 4 then cos end) - avg(case when a % 4 <> b % 4 then cos end), 6) as region from cc")
def q_centroid_sep(spark, sf_dir):
    rows = _centroids(spark, sf_dir)
    def gap(m):
        same = F.col("a") % m == F.col("b") % m
        return F.round(F.avg(F.when(same, F.col("cos"))) - F.avg(F.when(~same, F.col("cos"))), 6)
    return rows.agg(gap(3).alias("category"), gap(4).alias("region"))


@query(f"""with {X.SIGNAL}, {CENTROIDS} select v.label, round(avg(list_dot_product(v.e, mu.m) / len), 6) as spread, count(*) as n from v join mu using (label) group by v.label""")
def q_class_spread(spark, sf_dir):
    rows = X.signal_vectors(spark, sf_dir)
    means = R.class_means(rows, X.DIMS).select("label", "mean")
    return rows.join(F.broadcast(means), "label").groupBy("label").agg(F.round(F.avg(V.dot(F.col("e"), F.col("mean"))), 6).alias("spread"), F.count(F.lit(1)).alias("n"))


@query(f"""with {X.SIGNAL}, {NEAR}, o as (select v.vec_id, count(nn.g)::double as k from v left join nn on nn.g = v.vec_id and nn.k <= 10 group by v.vec_id),
st as (select avg(k) as mean, stddev_pop(k) as std, max(k) as most, quantile_cont(k, 0.99) as p99 from o) select round(mean, 6) as mean, round(std, 6) as std, most, round(p99, 6) as p99, round((select avg(pow((k - mean) / (std + 1e-9), 3)) from o), 6) as skew from st""")
def q_hubness(spark, sf_dir):
    asked, gallery = _search(spark, sf_dir)
    rows = M.hubness(R.nearest(asked, gallery, 10), gallery)
    return rows.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "most", F.round("p99", 6).alias("p99"), F.round("skew", 6).alias("skew"))


@query(f"""with {X.SIGNAL}, {NEAR} select round(avg((q // 75 = g // 75)::int), 6) as same_source, round(avg(case when q // 75 = g // 75 then (truth = label)::int end), 6) as acc_same, round(avg(case when q // 75 <> g // 75 then (truth = label)::int end), 6) as acc_other from nn where k = 1""")
def q_nn_same_source(spark, sf_dir):
    asked, gallery = _search(spark, sf_dir)
    near = R.nearest(asked, gallery, 1).join(asked.select(F.col("vec_id").alias("q"), F.col("label").alias("truth")), "q")
    same, hit = F.expr("q div 75 = g div 75"), (F.col("truth") == F.col("label")).cast("int")
    return near.agg(F.round(F.avg(same.cast("int")), 6).alias("same_source"), F.round(F.avg(F.when(same, hit)), 6).alias("acc_same"), F.round(F.avg(F.when(~same, hit)), 6).alias("acc_other"))


@query(f"""with {X.SIGNAL}, s as (select vec_id % 2 as side, i, sum(e[i + 1]) as t, count(*) as n from v, range(64) d(i) group by all), sq as (select vec_id % 2 as side, sum(list_dot_product(e, e)) as q, count(*) as n from v group by 1),
w as (select s.side, sum(t * t) as tt from s group by side)
select round((select sum(a.t * b.t) from s a join s b on a.i = b.i and a.side = 0 and b.side = 1) / ((select n from sq where side = 0) * (select n from sq where side = 1)), 6) as across,
 round((select (tt - q) / (n * (n - 1)) from w join sq using (side) where side = 0), 6) as within0, round((select (tt - q) / (n * (n - 1)) from w join sq using (side) where side = 1), 6) as within1""")
def q_domain_gap(spark, sf_dir):
    """Mean cosines within and across two collections from vector sums: no pairs are made."""
    rows = X.signal_vectors(spark, sf_dir).withColumn("side", F.col("vec_id") % 2)
    sums = rows.groupBy("side").agg(F.array(*[F.sum(F.col("e")[i]) for i in range(X.DIMS)]).alias("t"), F.sum(V.dot(F.col("e"), F.col("e"))).alias("q"), F.count(F.lit(1)).alias("n"))
    at = {k: F.max(F.when(F.col("side") == k, F.struct("t", "q", "n"))) for k in (0, 1)}
    one = sums.agg(at[0].alias("a"), at[1].alias("b"))
    def within(s):
        return F.round((V.dot(F.col(f"{s}.t"), F.col(f"{s}.t")) - F.col(f"{s}.q")) / (F.col(f"{s}.n") * (F.col(f"{s}.n") - 1)), 6)
    return one.select(F.round(V.dot(F.col("a.t"), F.col("b.t")) / (F.col("a.n") * F.col("b.n")), 6).alias("across"), within("a").alias("within0"), within("b").alias("within1"))


PRED = """r as (select *, row_number() over (partition by seed, q order by best desc, label) as rk from sc), p as (select seed, q, truth, label as pred from r where rk = 1)"""


def _errors(spark, sf_dir):
    scores, truth = scored(spark, sf_dir)
    ranked = R.ranked(R.exemplar(scores)).where("rank = 1").select("seed", "q", F.col("label").alias("pred"))
    return ranked.join(truth, ["seed", "q"])


@query(f"with {X.SIGNAL}, {X.scores_sql(SEEDS)}, {PRED} select truth, pred, count(*) as count from p where truth <> pred group by all order by count desc, truth, pred limit 20")
def q_confusions(spark, sf_dir):
    return M.top_counts(_errors(spark, sf_dir).where("truth <> pred"), ["truth", "pred"], 20)


@query(f"with {X.SIGNAL}, {X.scores_sql(SEEDS)}, {PRED} select least(truth, pred) as a, greatest(truth, pred) as b, count(*) as n, sum((truth < pred)::int)::bigint as a_as_b from p where truth <> pred group by 1, 2 having count(*) >= 3")
def q_confusion_pairs_sym(spark, sf_dir):
    return M.symmetric_confusions(_errors(spark, sf_dir).where("truth <> pred"))


@query(f"with {X.SIGNAL}, {X.scores_sql(SEEDS)}, {PRED} select round(avg((truth % 3 = pred % 3)::int), 6) as same_category, count(*) as errors from p where truth <> pred")
def q_same_category_errors(spark, sf_dir):
    return _errors(spark, sf_dir).where("truth <> pred").agg(F.round(F.avg((F.col("truth") % 3 == F.col("pred") % 3).cast("int")), 6).alias("same_category"), F.count(F.lit(1)).alias("errors"))


@query(f"with {X.SIGNAL}, {X.scores_sql(SEEDS)}, {PRED} select truth % 3 as category, count(*) as n, round(avg((truth = pred)::int), 6) as accuracy from p group by 1 having count(*) >= 10")
def q_accuracy_by_category(spark, sf_dir):
    return _errors(spark, sf_dir).groupBy((F.col("truth") % 3).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("truth") == F.col("pred")).cast("int")), 6).alias("accuracy")).where("n >= 10")


@query(f"""with {X.SIGNAL}, {X.scores_sql(SEEDS)}, {PRED}, sup as (select seed, q, max(case when label = truth then n end) as n from sc group by seed, q), z as (select p.*, coalesce(n, 0) as n from p join sup using (seed, q))
select least(n, 4) as support, case when n <= 2 then '2' when n = 3 then '3' when n <= 5 then '4-5' else '6+' end as shots, count(*) as asked, round(avg((truth = pred)::int), 6) as accuracy from z group by all""")
def q_strata_support(spark, sf_dir):
    scores, truth = scored(spark, sf_dir, stats=("best", "n"))
    rows = R.ranked(R.exemplar(scores)).where("rank = 1").select("seed", "q", F.col("label").alias("pred")).join(truth, ["seed", "q"])
    support = scores.join(truth, ["seed", "q"]).where("label = truth").select("seed", "q", "n")
    rows = rows.join(support, ["seed", "q"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy(M.support_bucket(F.col("n")).alias("support"), M.shot_bucket(F.col("n")).alias("shots")).agg(F.count(F.lit(1)).alias("asked"), F.round(F.avg((F.col("truth") == F.col("pred")).cast("int")), 6).alias("accuracy"))


def _accs_sql(*scores: str) -> str:
    parts = ", ".join(f"r{k} as (select seed, q, truth, label, row_number() over (partition by seed, q order by {s} desc, label) as rk from sc), a{k} as (select seed, 100.0::double * avg((label = truth)::int) as acc from r{k} where rk = 1 group by seed)" for k, s in enumerate(scores))
    return f"with {X.SIGNAL}, {X.scores_sql(SEEDS)}, {parts}"


@query(_accs_sql("best", "kernel") + ", d as (select a1.acc - a0.acc as d from a0 join a1 using (seed)) select round(avg(d), 6) as delta, sum((d > 0)::int)::bigint as wins, count(*) as n, case when avg(d) > 0 and sum((d > 0)::int) >= 7 then 'adopt' else 'keep' end as verdict from d")
def q_paired_delta(spark, sf_dir):
    scores, truth = scored(spark, sf_dir, stats=("best", "kernel"))
    def acc(s):
        top = R.ranked(s).where("rank = 1").join(truth, ["seed", "q"])
        return top.groupBy("seed").agg((100.0 * F.avg((F.col("label") == F.col("truth")).cast("double"))).alias("acc"))
    rows = M.paired(acc(R.exemplar(scores)), acc(R.kernel_density(scores)), "acc")
    return rows.select(F.round("delta", 6).alias("delta"), "wins", "n", M.verdict(F.col("delta"), F.col("wins")).alias("verdict"))


@query(_accs_sql("best", "kernel", "total / n") + " select config, round(avg(acc), 6) as acc from (select 'exemplar' as config, acc from a0 union all select 'kernel', acc from a1 union all select 'mean', acc from a2) group by config order by avg(acc) desc, config limit 1")
def q_best_config(spark, sf_dir):
    scores, truth = scored(spark, sf_dir, stats=("best", "total", "n", "kernel"))
    tables = {"exemplar": F.col("best"), "kernel": F.col("kernel"), "mean": F.col("total") / F.col("n")}
    rows = scores.select("seed", "q", "label", F.explode(F.create_map(*[v for k, c in tables.items() for v in (F.lit(k), c)])).alias("config", "score"))
    w = W.partitionBy("config", "seed", "q").orderBy(F.desc("score"), "label")
    top = rows.withColumn("r", F.row_number().over(w)).where("r = 1").join(truth, ["seed", "q"])
    acc = top.groupBy("config", "seed").agg((100.0 * F.avg((F.col("label") == F.col("truth")).cast("double"))).alias("acc")).groupBy("config").agg(F.avg("acc").alias("acc"))
    return acc.orderBy(F.desc("acc"), "config").limit(1).select("config", F.round("acc", 6).alias("acc"))


@query(f"""with {X.SIGNAL}, {X.split_sql(1)}, fr as (select unnest([0.25, 0.5, 0.75, 1.0])::double as f), tr as (select unit, row_number() over (order by md5('0|' || unit::varchar), unit) as k, count(*) over () as n from (select unit from split where not is_test)),
g as (select f, v.* from fr, tr join v using (unit) where k <= greatest(1, ceil(f * n - 1e-9))), q as (select v.* from v join split using (unit) where is_test),
b as (select f, q.vec_id as q, q.label as truth, g.label, max(list_dot_product(q.e, g.e)) as s from q, g group by all), r as (select *, row_number() over (partition by f, q order by s desc, label) as rk from b),
t as (select f, q, truth, max(case when rk = 1 then label end) as pred, bool_or(label = truth) as cov from r group by all)
select f as fraction, round(100.0 * avg(case when cov then (truth = pred)::int end), 6) as top1, round(100.0 * avg(cov::int), 6) as coverage from t group by f""")
def q_learning_curve(spark, sf_dir):
    """Nested shares of the gallery on the same test rows; shares take the place of seeds in one scoring pass."""
    fractions = [0.25, 0.5, 0.75, 1.0]
    rows = X.signal_vectors(spark, sf_dir)
    split = S.grouped_split(rows, "unit")
    train = rows.join(split.where("not is_test").select("unit"), "unit")
    nested = S.nested_fractions(train, "unit", fractions).withColumn("bit", F.expr("int(fraction * 4) - 1"))
    gallery = train.join(nested.groupBy("unit").agg(F.sum(S.bit(F.col("bit"))).alias("mask")), "unit")
    asked = rows.join(split.where("is_test").select("unit"), "unit").withColumn("mask", F.lit(15))
    ranked = R.ranked(R.exemplar(R.class_scores(asked, gallery, (0, 1, 2, 3), stats=("best",))))
    truth = asked.select(F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("seed"), F.col("vec_id").alias("q"), F.col("label").alias("truth"))
    acc = M.accuracy(M.truth_ranks(ranked, truth))
    return acc.select(((F.col("seed") + 1) / 4.0).alias("fraction"), F.round("top1", 6).alias("top1"), F.round("coverage", 6).alias("coverage"))


@query(f"""with {X.SIGNAL}, {X.scores_sql(1)}, {PRED}, o as (select row_number() over (order by md5(q::varchar), q) - 1 as i, (truth = pred)::int::double as v, count(*) over () as n from p),
d as (select b as replicate, j, ('0x' || substring(md5('0|' || b::varchar || '|' || j::varchar), 1, 8))::bigint % (select max(n) from o) as i from range(2000) x(b), range((select max(n) from o)) y(j)),
m as (select replicate, avg(v) as mean from d join o using (i) group by replicate) select round((select avg(v) from o), 6) as mean, round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.975), 6) as high from m""")
def q_bootstrap_ci(spark, sf_dir):
    scores, truth = scored(spark, sf_dir, 1)
    rows = R.ranked(R.exemplar(scores)).where("rank = 1").join(truth, ["seed", "q"]).select("q", (F.col("label") == F.col("truth")).cast("int").alias("hit"))
    means = S.bootstrap_means(rows, "q", "hit")
    ci = means.agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"))
    return rows.agg(F.round(F.avg("hit"), 6).alias("mean")).join(ci)


@query(f"with {X.RAW}, {X.split_sql(3)} select seed, unit, is_test from split")
def q_split_units(spark, sf_dir):
    return S.grouped_split(X.raw_vectors(spark, sf_dir), "unit", 0.3, [0, 1, 2])


@query(f"with {X.RAW}, {X.split_sql(2)} select seed, unit, case when rk <= floor(n * 0.5) then 'gallery' when rk <= floor(n * 0.5) + floor(n * 0.2) then 'calibration' else 'test' end as side from split")
def q_three_way_split(spark, sf_dir):
    return S.three_way(X.raw_vectors(spark, sf_dir), "unit", seeds=[0, 1])


@query(f"with {X.RAW}, {X.split_sql(1)} select unit, ((rk - 1) % 5)::int as fold from split")
def q_source_folds(spark, sf_dir):
    return S.folds(X.raw_vectors(spark, sf_dir), "unit", 5)


@query(f"""with {X.RAW}, c as (select vec_id, ['a', 'b', 'c'][label % 3 + 1] as cat, vec_id % 4 <> 0 as ok from v), r as (select *, row_number() over (partition by cat, ok order by md5('0|' || vec_id::varchar), vec_id) as r, case cat when 'a' then 20 when 'b' then 15 else 10 end as k from c),
s as (select *, row_number() over (partition by cat order by case when (ok and r <= k - k // 2) or (not ok and r <= k // 2) then 0 else 1 end, ok::int, r, vec_id) as n from r) select vec_id, cat, ok from s where n <= k""")
def q_stratified_sample(spark, sf_dir):
    rows = X.raw_vectors(spark, sf_dir).select("vec_id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("label") % 3 + 1).cast("int")).alias("cat"), (F.col("vec_id") % 4 != 0).alias("ok"))
    return S.stratified_sample(rows, "cat", "ok", "vec_id", {"a": 20, "b": 15, "c": 10})
