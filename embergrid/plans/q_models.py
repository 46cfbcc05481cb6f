"""Fitted transforms, multi-prototypes, re-ranking, gates and nested selection."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embergrid.functions import vectors as V
from embergrid.operators import calibration as C
from embergrid.operators import clusters as K
from embergrid.operators import linear as L
from embergrid.operators import metrics as M
from embergrid.operators import retrieval as R
from embergrid.operators import splits as S
from embergrid.operators import transforms as T
from embergrid.sources.shared import staged

from . import fixtures as X
from .q_retrieval import PRED, SEEDS, _search, _sides, scored, seeds_of
from .registry import query


def _gallery_fit(spark, sf_dir, name: str) -> DataFrame:
    """Fit on the train side of one split, transform all, and report top-1."""
    asked, gallery, truth = _sides(X.signal_vectors(spark, sf_dir), 1)
    model = T.FITTERS[name](gallery.where("mask % 2 <> 0"))
    scores = R.class_scores(model.transform(asked), model.transform(gallery), stats=("best",))
    acc = M.accuracy(M.truth_ranks(R.ranked(R.exemplar(scores)), truth))
    return acc.select(F.lit(name).alias("method"), F.round("top1", 3).alias("top1"), F.round("coverage", 3).alias("coverage"))


@query()
def q_postprocessing(spark, sf_dir):
    """Registered fitters, fitted on the gallery alone; checked against NumPy in the tests."""
    out = None
    for name in T.FITTERS:
        part = _gallery_fit(spark, sf_dir, name)
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""with {X.RAW}, cm as (select vec_id // 75 as src, label, i, avg(e[i + 1]) as m from v, range(64) d(i) group by all), own as (select src, i, avg(m) as m from cm group by src, i),
am as (select label, i, avg(e[i + 1]) as m from v, range(64) d(i) group by all), alls as (select i, avg(m) as m from am group by i)
select vec_id, round(sum(pow(v.e[own.i + 1] - 0.5 * (own.m - alls.m), 2)), 6) as energy from v join own on own.src = v.vec_id // 75 join alls on alls.i = own.i group by vec_id""")
def q_source_centring(spark, sf_dir):
    rows = X.raw_vectors(spark, sf_dir).withColumn("src", F.expr("vec_id div 75"))
    return T.source_centred(rows, X.DIMS, "src", 0.5).select("vec_id", F.round(V.dot(F.col("e"), F.col("e")), 6).alias("energy"))


@query()
def q_multi_prototype(spark, sf_dir):
    """Per-class spherical k-means in fixed rounds; tested against a loop."""
    asked, gallery = _search(spark, sf_dir)
    centres = K.prototypes(gallery.select("vec_id", "label", "e"), X.DIMS)
    return K.multi_prototype_scores(asked, centres).select("q", "label", F.round("score", 6).alias("score"))


@query()
def q_k_reciprocal(spark, sf_dir):
    """Re-ranking of search results by reciprocal neighbours (k1 = 10, k2 = 3) over the whole gallery; tested against a matrix form."""
    asked, gallery = _search(spark, sf_dir)
    rows = staged(gallery.join(R.farthest(gallery, gallery).withColumnRenamed("q", "vec_id"), "vec_id"), "scaled")
    near = staged(R.scaled_nearest(rows, 10), "near")
    self_ = gallery.select(F.col("vec_id").alias("i"), F.col("vec_id").alias("j"), F.lit(0.0).alias("d"), F.lit(0).alias("rank"))
    ranked = near.unionByName(self_)
    lookup = partial(R.scaled_pairs, rows=rows)
    encoded = staged(K.reciprocal_weights(ranked, 10, 3, lookup), "encoded")
    wanted = asked.select(F.col("vec_id").alias("q"))
    top = near.join(wanted.select(F.col("q").alias("i")), "i", "left_semi").select(F.col("i").alias("q"), F.col("j").alias("g"), "d")
    out = K.reciprocal_distance(encoded, wanted, top, lookup=lookup)
    w = W.partitionBy("q").orderBy("d", "g")
    return out.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("q", "g", "rank", F.round("d", 6).alias("d"))


@query(f"""with {X.SIGNAL}, d as (select a.vec_id, a.label, b.label as other, sum(list_distance(a.e, b.e) * list_distance(a.e, b.e)) as s, count(*) as n from v a, v b group by all),
own as (select vec_id, s / nullif(n - 1, 0) as a, n from d where label = other), near as (select vec_id, min(s / n) as b from d where label <> other group by 1)
select round(avg(case when n = 1 then 0.0::double else (b - a) / greatest(a, b) end), 4) as silhouette, count(*) as n from own join near using (vec_id)""")
def q_silhouette(spark, sf_dir):
    """Mean silhouette of the labels by squared distances, from the classes' sums."""
    return K.silhouette(X.signal_vectors(spark, sf_dir), X.DIMS).select(F.round("silhouette", 4).alias("silhouette"), "n")


def _categories(spark, sf_dir, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of test rows, their truth, and their category probabilities (seed, q, cat, p) from a linear classifier of the gallery's categories."""
    asked, gallery, truth = _sides(X.signal_vectors(spark, sf_dir), seeds)
    train = gallery.where("mask <> 0").select(seeds_of(seeds).alias("fold"), (F.col("label") % 3).cast("int").alias("cls"), "e")
    found = L.discriminants(L.moments(train, X.DIMS), X.DIMS)
    met = L.scores(asked.select(seeds_of(seeds).alias("fold"), F.col("vec_id").alias("q"), "e"), found)
    probs = C.softmax(met.select(F.col("fold").alias("seed"), "q", F.col("cls").alias("label"), "score")).select("seed", "q", F.col("label").alias("cat"), "p")
    return R.exemplar(R.class_scores(asked, gallery, tuple(range(seeds)), stats=("best",))), truth, probs


def _top1(scores: DataFrame, truth: DataFrame, name: str) -> DataFrame:
    acc = M.accuracy(M.truth_ranks(R.ranked(scores), truth))
    return acc.groupBy().agg(F.lit(name).alias("method"), F.round(F.avg("top1"), 3).alias("top1"))


GATES = f"""with {X.SIGNAL}, {X.scores_sql(SEEDS)}, tr as (select seed, (label % 3)::int as cls, e from split join v using (unit) where not is_test), md as (select seed, cls, i, count(*) as n, avg(e[i + 1]) as m, sum(e[i + 1] * e[i + 1]) - sum(e[i + 1]) * sum(e[i + 1]) / count(*) as inner_q from tr, range(64) d(i) group by seed, cls, i),
vr as (select seed, i, sum(inner_q) / sum(n) + 1e-9 as va from md group by seed, i), ds as (select seed, cls, list(m / va order by i) as w, any_value(n) as n, sum(m * m / va) as mm from md join vr using (seed, i) group by seed, cls),
db as (select seed, cls, w, ln(n / sum(n) over (partition by seed)) - mm / 2 as b from ds), lo as (select a.seed, q.vec_id as q, q.label as truth, cls as cat, list_dot_product(q.e, w) + b as s from split a join v q on q.unit = a.unit and a.is_test join db on db.seed = a.seed),
ex as (select *, exp(s - max(s) over (partition by seed, q)) as z from lo), cp as (select seed, q, truth, cat, z / sum(z) over (partition by seed, q) as p from ex), co as (select *, row_number() over (partition by seed, q order by p desc, cat) as o, max(p) over (partition by seed, q) as most from cp),
j as (select sc.seed, sc.q, sc.truth, sc.label, best, p, most, o from sc join co on co.seed = sc.seed and co.q = sc.q and co.cat = sc.label % 3),
u as (select 'none' as method, seed, q, truth, label, best as score from j union all select 'soft', seed, q, truth, label, best + 0.2::double * ln(greatest(1e-4, p)) from j union all select 'modulated', seed, q, truth, label, best + 0.2::double * most * ln(greatest(1e-4, p)) from j union all select 'hard', seed, q, truth, label, case when o <= 2 then best else -9 end from j),
r as (select *, row_number() over (partition by method, seed, q order by score desc, label) as rk from u), asked as (select distinct seed, q, truth from lo), ms as (select unnest(['none', 'soft', 'modulated', 'hard']) as method),
t as (select ms.method, asked.seed, 100.0::double * avg(coalesce((r.rk = 1)::int, 0)) as top1 from asked join ms on true left join r on r.method = ms.method and r.seed = asked.seed and r.q = asked.q and r.label = asked.truth group by ms.method, asked.seed)
select method, round(avg(top1), 3) as top1 from t group by method union all select 'category', round(avg(a), 3) from (select seed, 100.0::double * avg((cat = truth % 3)::int) as a from co where o = 1 group by seed)"""


@query(GATES)
def q_category_gates(spark, sf_dir):
    """Soft gate (score + lambda log P(category)), confidence-modulated gate, hard gate to two categories, and the classifier's accuracy; ten seeds."""
    scores, truth, probs = _categories(spark, sf_dir)
    by = W.partitionBy("seed", "q")  # a row for each category of one query
    gates = probs.withColumns({"most": F.max("p").over(by), "o": F.row_number().over(by.orderBy(F.desc("p"), "cat"))})
    gates = staged(gates, "gates")
    rows = staged(scores.withColumn("cat", (F.col("label") % 3).cast("int")).join(gates, ["seed", "q", "cat"]), "gated")
    logp = F.log(F.greatest(F.lit(1e-4), F.col("p")))
    methods = {"none": F.col("score"), "soft": F.col("score") + 0.2 * logp, "modulated": F.col("score") + 0.2 * F.col("most") * logp, "hard": F.when(F.col("o") <= 2, F.col("score")).otherwise(-9.0)}
    parts = [_top1(rows.select("seed", "q", "label", s.alias("score")), truth, name) for name, s in methods.items()]
    hit = gates.where("o = 1").join(truth, ["seed", "q"]).groupBy("seed").agg((100.0 * F.avg((F.col("cat") == F.col("truth") % 3).cast("int"))).alias("a"))
    parts.append(hit.groupBy().agg(F.lit("category").alias("method"), F.round(F.avg("a"), 3).alias("top1")))
    return reduce(DataFrame.unionByName, parts)


PRIOR = f"""with {X.SIGNAL}, {X.scores_sql(SEEDS)}, us as (select unit, i, avg(e[i + 1]) as m from v, range(64) d(i) group by unit, i), ul as (select unit, list(m order by i) as m from us group by unit), un as (select unit, m, sqrt(list_dot_product(m, m)) + 1e-9 as len from ul),
cu as (select unit, list_transform(m, lambda x: x / len) as c from un), cs as (select seed, label, i, avg(c[i + 1]) as m from split join v using (unit) join cu using (unit), range(64) d(i) where not is_test group by seed, label, i), cm as (select seed, label, list(m order by i) as m from cs group by seed, label),
w as (select unnest([0.0, 0.1, 0.3])::double as weight), s as (select weight, sc.seed, sc.q, truth, sc.label, best + weight * list_dot_product(cu.c, cm.m) / (sqrt(list_dot_product(cm.m, cm.m)) + 1e-9) as score from sc join v on v.vec_id = sc.q join cu on cu.unit = v.unit join cm on cm.seed = sc.seed and cm.label = sc.label, w),
r as (select *, row_number() over (partition by weight, seed, q order by score desc, label) as rk from s), t as (select weight, seed, 100.0::double * avg((rk <= 1)::int) as top1, 100.0::double * avg((rk <= 5)::int) as top5 from r where label = truth group by weight, seed)
select weight, round(avg(top1), 6) as top1, round(avg(top5), 6) as top5 from t group by weight"""


@query(PRIOR)
def q_region_prior(spark, sf_dir):
    """Appearance score + weight * cosine of the unit's mean vector (its context) to the class's mean context in the gallery."""
    rows = X.signal_vectors(spark, sf_dir)
    asked, gallery, truth = _sides(rows, SEEDS)
    context = R.class_means(rows, X.DIMS, by=("unit",)).select("unit", F.col("mean").alias("e"))
    around = gallery.drop("e").join(context, "unit").withColumn("seed", seeds_of())
    means = R.class_means(around, X.DIMS, by=("seed", "label")).select("seed", "label", "mean")
    queries = truth.select("seed", F.col("q").alias("vec_id")).join(asked.select("vec_id", "unit"), "vec_id").join(context, "unit").select("seed", "vec_id", "e")
    prior = R.prototype(queries, F.broadcast(means), ["seed"]).withColumnRenamed("score", "prior")  # one row a class and seed
    both = R.exemplar(R.class_scores(asked, gallery, tuple(range(SEEDS)), stats=("best",))).join(prior, ["seed", "q", "label"])
    every = both.withColumn("weight", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.1, 0.3)]))).withColumn("score", F.col("score") + F.col("weight") * F.col("prior"))
    place = F.row_number().over(W.partitionBy("weight", "seed", "q").orderBy(F.desc("score"), "label"))
    own = every.withColumn("place", place).join(truth, ["seed", "q"]).where("label = truth")
    per = own.groupBy("weight", "seed").agg(*(F.avg(F.when(F.col("place") <= k, 100.0).otherwise(0.0)).alias(f"top{k}") for k in (1, 5)))
    return per.groupBy("weight").agg(F.round(F.avg("top1"), 6).alias("top1"), F.round(F.avg("top5"), 6).alias("top5"))


@query(f"""with {X.SIGNAL}, {X.split_sql(2)}, g as (select b.seed, x.side, v.* from split b join v using (unit), (select unnest(['small', 'all']) as side) x where not b.is_test and (x.side = 'all' or v.label < 7)),
q as (select a.seed, v.* from split a join v using (unit) where a.is_test), s as (select q.seed, side, q.vec_id as q, q.label as truth, g.label, max(list_dot_product(q.e, g.e)) as s from q join g using (seed) group by all),
r as (select *, row_number() over (partition by seed, side, q order by s desc, label) as rk from s), t as (select seed, side, q, truth, max(case when rk = 1 then label end) as pred, bool_or(label = truth) as cov from r group by all)
select side, round(100.0 * avg(case when cov then (pred = truth)::int end), 6) as top1, round(100.0 * avg(cov::int), 6) as coverage, count(distinct case when cov then truth end) as vocabulary from t group by side""")
def q_gallery_variants(spark, sf_dir):
    """A gallery and a larger one on the same test rows: variants take the place of more seeds in one scoring pass."""
    rows = S.masks(X.signal_vectors(spark, sf_dir), "unit", S.grouped_split(X.signal_vectors(spark, sf_dir), "unit", 0.3, [0, 1]))
    test = F.col("test_mask").bitwiseAND(3)
    train = F.bitwise_not(F.col("test_mask")).bitwiseAND(3)
    asked = rows.withColumn("mask", test + test * 4).where("mask > 0")
    gallery = rows.withColumn("mask", train * 4 + F.when(F.col("label") < 7, train).otherwise(0))
    ranked = R.ranked(R.exemplar(R.class_scores(asked, gallery, (0, 1, 2, 3), stats=("best",))))
    bits = F.explode(F.filter(F.array(*[F.when(F.shiftright("mask", s).bitwiseAND(1) == 1, s) for s in range(4)]), lambda x: x.isNotNull()))
    truth = asked.select(bits.alias("seed"), F.col("vec_id").alias("q"), F.col("label").alias("truth"))
    ranks = M.truth_ranks(ranked, truth).withColumn("side", F.when(F.col("seed") < 2, "small").otherwise("all"))
    covered = F.col("rank_true").isNotNull()
    return ranks.groupBy("side").agg(F.round(100.0 * F.avg(F.when(covered, (F.col("pred") == F.col("truth")).cast("int"))), 6).alias("top1"), F.round(100.0 * F.avg(covered.cast("int")), 6).alias("coverage"), F.countDistinct(F.when(covered, F.col("truth"))).alias("vocabulary"))


@query(f"""with {X.SIGNAL}, {X.scores_sql(SEEDS)}, c as (select seed, q, truth, label, best, kernel, total / n as mean from sc), r as (
 select seed, q, truth, 'exemplar' as config, label, row_number() over (partition by seed, q order by best desc, label) as rk from c union all select seed, q, truth, 'kernel', label, row_number() over (partition by seed, q order by kernel desc, label) from c union all select seed, q, truth, 'mean', label, row_number() over (partition by seed, q order by mean desc, label) from c),
a as (select config, seed, 100.0::double * avg((label = truth)::int) as acc from r where rk = 1 group by config, seed), d as (select h.seed as held, x.config, avg(x.acc) as dev from (select distinct seed from a) h join a x on x.seed <> h.seed group by all),
b as (select held, arg_min(config, (-dev, config)) as config, max(dev) as dev from d group by held) select round(avg(b.dev), 6) as dev, round(avg(a.acc), 6) as held_out, round(avg(b.dev) - avg(a.acc), 6) as gap from b join a on a.seed = b.held and a.config = b.config""")
def q_nested_selection(spark, sf_dir):
    """Choose the configuration on the other seeds, score it on the held-out one, and decompose the gap."""
    scores, truth = scored(spark, sf_dir, stats=("best", "total", "n", "kernel"))
    tables = {"exemplar": F.col("best"), "kernel": F.col("kernel"), "mean": F.col("total") / F.col("n")}
    rows = scores.select("seed", "q", "label", F.explode(F.create_map(*[v for k, c in tables.items() for v in (F.lit(k), c)])).alias("config", "score"))
    top = rows.withColumn("r", F.row_number().over(W.partitionBy("config", "seed", "q").orderBy(F.desc("score"), "label"))).where("r = 1").join(truth, ["seed", "q"])
    acc = top.groupBy("config", "seed").agg((100.0 * F.avg((F.col("label") == F.col("truth")).cast("double"))).alias("acc"))
    held = acc.select(F.col("seed").alias("held")).distinct()
    dev = acc.join(F.broadcast(held), F.col("seed") != F.col("held")).groupBy("held", "config").agg(F.avg("acc").alias("dev"))
    best = dev.groupBy("held").agg(F.min(F.struct((-F.col("dev")).alias("d"), "config")).alias("m")).select("held", F.col("m.config").alias("config"), (-F.col("m.d")).alias("dev"))
    out = best.join(acc.withColumnRenamed("seed", "held"), ["held", "config"]).agg(F.avg("dev").alias("dev"), F.avg("acc").alias("held_out"))
    return out.select(F.round("dev", 6).alias("dev"), F.round("held_out", 6).alias("held_out"), F.round(F.col("dev") - F.col("held_out"), 6).alias("gap"))


@query(f"""with {X.SIGNAL}, {X.scores_sql(2)}, a as (select seed, q, label, row_number() over (partition by seed, q order by best desc, label) as ra, row_number() over (partition by seed, q order by kernel desc, label) as rb, truth from sc)
select round(avg((ra > rb)::int), 6) as better, round(avg((ra < rb)::int), 6) as worse, round(avg(greatest(-5, least(5, ra - rb))), 6) as shift from a where label = truth""")
def q_rank_shift(spark, sf_dir):
    scores, truth = scored(spark, sf_dir, 2, stats=("best", "kernel"))
    a, b = R.ranked(R.exemplar(scores)), R.ranked(R.kernel_density(scores))
    rows = a.select("seed", "q", "label", F.col("rank").alias("ra")).join(b.select("seed", "q", "label", F.col("rank").alias("rb")), ["seed", "q", "label"]).join(truth, ["seed", "q"]).where("label = truth")
    return rows.agg(F.round(F.avg((F.col("ra") > F.col("rb")).cast("int")), 6).alias("better"), F.round(F.avg((F.col("ra") < F.col("rb")).cast("int")), 6).alias("worse"), F.round(F.avg(F.greatest(F.lit(-5), F.least(F.lit(5), F.col("ra") - F.col("rb")))), 6).alias("shift"))


@query(f"with {X.SIGNAL}, {X.scores_sql(SEEDS)}, {PRED} select seed, round(100.0 * avg((truth = pred)::int), 6) as top1, round(100.0 / (select count(distinct label) from v), 6) as chance, round(avg((truth = pred)::int) * (select count(distinct label) from v), 6) as ratio from p group by seed")
def q_chance_ratio(spark, sf_dir):
    scores, truth = scored(spark, sf_dir)
    top = R.ranked(R.exemplar(scores)).where("rank = 1").join(truth, ["seed", "q"])
    classes = X.signal_vectors(spark, sf_dir).agg(F.countDistinct("label").alias("k"))
    rows = top.groupBy("seed").agg(F.avg((F.col("label") == F.col("truth")).cast("double")).alias("a")).join(F.broadcast(classes))
    return rows.select("seed", F.round(100 * F.col("a"), 6).alias("top1"), F.round(100.0 / F.col("k"), 6).alias("chance"), F.round(F.col("a") * F.col("k"), 6).alias("ratio"))


@query(f"""with {X.SIGNAL}, {X.scores_sql(SEEDS)}, r as (select seed, q, truth, label, row_number() over (partition by seed, q order by best desc, label) as rk from sc), t as (select seed, q, max(case when label = truth then rk end) as rt from r group by seed, q)
select k, round(100.0 * avg(coalesce((rt <= k)::int, 0)), 6) as recall from t, (select unnest([1, 3, 5, 10]) as k) group by k""")
def q_recall_at_k(spark, sf_dir):
    scores, truth = scored(spark, sf_dir)
    ranks = M.truth_ranks(R.ranked(R.exemplar(scores)), truth).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10)])))
    return ranks.groupBy("k").agg(F.round(100.0 * F.avg(F.coalesce((F.col("rank_true") <= F.col("k")).cast("int"), F.lit(0))), 6).alias("recall"))


TEMPERATURE = f"""with {X.SIGNAL}, {X.scores_sql(SEEDS)}, tl as (select seed, q, list(best) as xs, max(best) as top, max(case when label = truth then best end) as xt from sc group by seed, q), ls as (select seed, q, list_transform(xs, lambda x: x - top) as xs, xt - top as xt from tl where xt is not null),
s1 as (select seed, round(1.0::double + k * 1.0::double, 6) as s from (select distinct seed from ls), range(60) r(k)), n1 as (select seed, s, avg(-ln(exp(s * xt) / list_sum(list_transform(xs, lambda x: exp(s * x))) + 1e-12)) as nll from ls join s1 using (seed) group by seed, s), b1 as (select seed, arg_min(s, (round(nll, 12), s)) as s from n1 group by seed),
s2 as (select seed, round(greatest(1.0, s - 20 * 0.05::double) + k * 0.05::double, 6) as s from b1, range(41) r(k)), n2 as (select seed, s, avg(-ln(exp(s * xt) / list_sum(list_transform(xs, lambda x: exp(s * x))) + 1e-12)) as nll from ls join s2 using (seed) group by seed, s), b2 as (select seed, arg_min(s, (round(nll, 12), s)) as s from n2 group by seed),
s3 as (select seed, round(greatest(1.0, s - 20 * 0.0025::double) + k * 0.0025::double, 6) as s from b2, range(41) r(k)), n3 as (select seed, s, avg(-ln(exp(s * xt) / list_sum(list_transform(xs, lambda x: exp(s * x))) + 1e-12)) as nll from ls join s3 using (seed) group by seed, s), b3 as (select seed, arg_min(s, (round(nll, 12), s)) as scale from n3 group by seed),
h as (select seed, 'before' as era, 1.0::double as s from b3 union all select seed, 'after', scale from b3), z as (select era, sc.seed, q, truth, label, exp(s * (best - max(best) over (partition by era, sc.seed, q))) as z from sc join h on h.seed = sc.seed), p as (select era, seed, q, truth, label, z / sum(z) over (partition by era, seed, q) as p from z),
cf as (select era, seed, q, max(p) as conf, arg_min(label, (-p, label)) = any_value(truth) as correct, max(case when label = truth then p end) as pt from p group by era, seed, q), bn as (select era, seed, greatest(ceil(conf * 15), 1) as b, count(*) as n, abs(avg(correct::int) - avg(conf)) as gap from cf where pt is not null group by all), ec as (select era, seed, sum(n * gap) / sum(n) as ece, sum(n)::bigint as n from bn group by era, seed)
select b3.seed, round(scale, 4) as scale, round(x.ece, 6) as ece_before, round(y.ece, 6) as ece_after, x.n from b3 join ec x on x.seed = b3.seed and x.era = 'before' join ec y on y.seed = b3.seed and y.era = 'after'"""


@query(TEMPERATURE)
def q_temperature(spark, sf_dir):
    """Scale of least negative log-likelihood by three passes of candidates, and the calibration error before and after; ten seeds."""
    scores, truth = scored(spark, sf_dir)
    rows = staged(scores.select("seed", "q", "label", F.col("best").alias("score")).join(truth, ["seed", "q"]), "scores")
    found = C.fit_temperature(rows)
    def error(scale, name):
        conf = C.confidences(C.softmax(rows.join(F.broadcast(found), "seed").select("seed", "q", "label", "score", "scale"), scale).drop("scale"), truth)
        return C.ece(conf, 15).select("seed", F.round("ece", 6).alias(name)), conf
    (before, conf), (after, _) = error(F.lit(1.0), "ece_before"), error(F.col("scale"), "ece_after")
    return found.select("seed", F.round("scale", 4).alias("scale")).join(before, "seed").join(after, "seed").join(conf.groupBy("seed").agg(F.count(F.lit(1)).alias("n")), "seed")
