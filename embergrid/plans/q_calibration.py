"""Calibration, selective prediction and decisions on leak-safe score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embergrid.operators import calibration as C
from embergrid.operators import retrieval as R
from embergrid.operators import splits as S
from embergrid.sources.shared import staged

from . import fixtures as X
from .q_retrieval import SEEDS, _sides, scored
from .registry import query

SCALE = 15.0
CONF = f"""{X.SIGNAL}, {X.scores_sql(SEEDS)}, x as (select *, exp({SCALE} * best - max({SCALE} * best) over (partition by seed, q)) as e from sc), p as (select seed, q, truth, label, e / sum(e) over (partition by seed, q) as p from x),
bp as (select seed, q, truth, max(p) as conf, min_by(label, (-p, label)) as pred, max(case when label = truth then p end) as p_true from p group by all),
conf as (select seed, q, truth, conf, pred, pred = truth as correct, p_true from bp where p_true is not null)"""
ORDERED = "o as (select *, row_number() over (partition by seed order by conf desc, q) as rk, count(*) over (partition by seed) as n, avg(correct::int) over (partition by seed order by conf desc, q rows unbounded preceding) as running from conf)"
CURVE = ORDERED + ", g as (select round(0.05::double * k, 2) as coverage from range(1, 21) r(k)), rc as (select seed, coverage, running as accuracy from o, g where rk = greatest(1, round_even(coverage * n, 0)))"


def _probs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    scores, truth = scored(spark, sf_dir)
    return C.softmax(R.exemplar(scores), SCALE), truth


def _conf(spark, sf_dir) -> DataFrame:
    return C.confidences(*_probs(spark, sf_dir))


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


@query(f"with {CONF} select seed, q, label, round(p, 6) as p from p")
def q_softmax(spark, sf_dir):
    probs, _ = _probs(spark, sf_dir)
    return probs.select("seed", "q", "label", F.round("p", 6).alias("p"))


def _ece_sql(bins: int, first: str) -> str:
    return f"with {CONF}, b as (select *, {first} as b from conf), a as (select seed, b, avg(correct::int) as acc, avg(conf) as c, count(*) as n from b group by seed, b) select seed, round(sum(case when b is null then 0 else abs(acc - c) * n end) / sum(n), 6) as ece from a group by seed"


@query(_ece_sql(15, "greatest(ceil(conf * 15), 1)"))
def q_ece_15(spark, sf_dir):
    return _r(C.ece(_conf(spark, sf_dir), 15), "ece")


@query(_ece_sql(10, "greatest(ceil(conf * 10), 1)"))
def q_ece_10(spark, sf_dir):
    return _r(C.ece(_conf(spark, sf_dir), 10), "ece")


@query(_ece_sql(10, "case when conf > 0 then ceil(conf * 10) end"))
def q_ece_left_open(spark, sf_dir):
    return _r(C.ece(_conf(spark, sf_dir), 10, first_closed=False), "ece")


@query(f"with {CONF}, {CURVE} select seed, coverage, round(accuracy, 6) as accuracy from rc")
def q_risk_coverage(spark, sf_dir):
    return _r(C.risk_coverage(_conf(spark, sf_dir)), "accuracy")


@query(f"""with {CONF}, {CURVE}, l as (select seed, coverage as x1, accuracy as y1, lag(coverage) over w as x0, lag(accuracy) over w as y0 from rc window w as (partition by seed order by coverage))
select seed, round(y0 + (y1 - y0) * (0.33::double - x0) / (x1 - x0), 6) as value from l where x1 >= 0.33 and x0 < 0.33""")
def q_curve_interpolation(spark, sf_dir):
    return _r(C.interpolate(C.risk_coverage(_conf(spark, sf_dir)), 0.33), "value")


@query(f"with {CONF}, {CURVE} select seed, coalesce(max(case when accuracy >= 0.7 then coverage end), 0) as coverage from rc group by seed")
def q_coverage_at_target(spark, sf_dir):
    return C.coverage_at(C.risk_coverage(_conf(spark, sf_dir)), 0.7)


@query(f"with {CONF}, {ORDERED} select seed, round(avg(1 - running), 6) as aurc from o group by seed")
def q_aurc(spark, sf_dir):
    return _r(C.aurc(_conf(spark, sf_dir)), "aurc")


@query(f"""with {CONF}, r as (select *, row_number() over (partition by seed order by conf, correct desc, q) as r from conf)
select seed, round(case when sum(correct::int) > 0 and sum((not correct)::int) > 0 then (sum(case when correct then r end) - sum(correct::int) * (sum(correct::int) + 1) / 2) / (sum(correct::int) * sum((not correct)::int)) end, 6) as auroc from r group by seed""")
def q_auroc(spark, sf_dir):
    return _r(C.auroc(_conf(spark, sf_dir).select("seed", "q", F.col("conf").alias("score"), F.col("correct").alias("positive"))), "auroc")


@query(f"with {CONF}, t as (select unnest(range(0, 21)) / 20.0::double as threshold) select seed, threshold, round(avg((conf >= threshold)::int), 6) as coverage, round(avg(case when conf >= threshold then correct::int end), 6) as accuracy from conf, t group by all")
def q_threshold_sweep(spark, sf_dir):
    return _r(C.threshold_sweep(_conf(spark, sf_dir), [k / 20 for k in range(21)]), "coverage", "accuracy")


@query(f"""with {CONF}, pc as (select seed, conf, count(*) as n, sum(correct::int) as c from conf group by seed, conf), cu as (select seed, conf, sum(n) over w as n, sum(c) over w as c from pc window w as (partition by seed order by conf desc rows unbounded preceding))
select seed, round(coalesce(min(case when n >= 5 and c >= 0.9 * n then conf end), 1.01), 6) as tau from cu group by seed""")
def q_operating_threshold(spark, sf_dir):
    return _r(C.operating_threshold(_conf(spark, sf_dir)), "tau")


@query(f"""with {CONF}, h as (select seed, sum(-p * log2(p)) as bits, max(p) as prob from p where p > 0 group by seed, q), d as (select seed, prob < 0.4 or bits > 2.5 as abstain, bits from h) select seed, round(avg(abstain::int), 6) as abstained, round(avg(bits), 6) as bits from d group by seed""")
def q_decisions(spark, sf_dir):
    probs, _ = _probs(spark, sf_dir)
    return C.decide(probs).groupBy("seed").agg(F.round(F.avg(F.col("abstain").cast("int")), 6).alias("abstained"), F.round(F.avg("entropy_bits"), 6).alias("bits"))


@query(f"with {CONF}, r as (select seed, q, p, row_number() over (partition by seed, q order by p desc) as r from p) select seed, q, round(sum(case when r = 1 then p when r = 2 then -p else 0 end), 6) as margin from r group by seed, q")
def q_margins(spark, sf_dir):
    probs, _ = _probs(spark, sf_dir)
    return _r(C.margins(probs), "margin")


@query(f"""with {X.SIGNAL}, {X.scores_sql(SEEDS)}, a as (select seed, q, label, exp({SCALE} * best) / sum(exp({SCALE} * best)) over (partition by seed, q) as p1, exp(total / n) / sum(exp(total / n)) over (partition by seed, q) as p2 from sc),
f as (select seed, q, label, exp(0.7 * ln(p1) + 0.3 * ln(p2)) as e from a) select seed, q, label, round(e / sum(e) over (partition by seed, q), 6) as p from f""")
def q_product_of_experts(spark, sf_dir):
    scores, _ = scored(spark, sf_dir, stats=("best", "total", "n"))
    a = C.softmax(R.exemplar(scores), SCALE).select("seed", "q", "label", "p")
    b = C.softmax(scores.select("seed", "q", "label", (F.col("total") / F.col("n")).alias("score"))).select("seed", "q", "label", "p")
    return C.fuse(a, b, 0.7, 0.3).select("seed", "q", "label", F.round("p", 6).alias("p"))


LOO = f"""{X.SIGNAL}, sims as (select q.vec_id as q, q.label as truth, g.vec_id as g, g.label, list_dot_product(q.e, g.e) as sim from v q, v g where q.vec_id <> g.vec_id), sc as (select q, truth, label, max(sim) as best, count(*) as n from sims group by all)"""


def _loo(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = X.signal_vectors(spark, sf_dir).withColumn("mask", F.lit(1))
    return R.class_scores(rows, rows, stats=("best",)), rows.select(F.lit(0).alias("seed"), F.col("vec_id").alias("q"), F.col("label").alias("truth"))


@query(f"""with {LOO}, g as (select s::double as s from range(2, 41) t(s)), x as (select s, q, truth, label, exp(s * best) as e from sc, g), p as (select s, q, truth, label, e / sum(e) over (partition by s, q) as p from x),
n as (select s, avg(-ln(p + 1e-12)) as nll from p where label = truth group by s) select s as scale, round(nll, 6) as nll from n order by nll, s limit 1""")
def q_fit_scale(spark, sf_dir):
    """Inverse temperature by grid search on leave-one-out scores."""
    scores, truth = _loo(spark, sf_dir)
    return C.fit_scale(R.exemplar(scores), truth, [float(s) for s in range(2, 41)]).select("scale", F.round("nll", 6).alias("nll"))


@query(f"""with {LOO.replace(", sc as (select q, truth, label, max(sim) as best, count(*) as n from sims group by all)", "")}, h as (select unnest([0.15, 0.2, 0.3, 0.4])::double as h), pr as (select label, count(*) as n from v group by label),
k as (select h, q, truth, sims.label, any_value(n) * sum(exp((sim - 1) / (h * h))) as j from sims, h, pr where pr.label = sims.label group by h, q, truth, sims.label), p as (select h, q, truth, label, j / (sum(j) over (partition by h, q) + 1e-30) as p from k),
l as (select h, avg(ln(p + 1e-12)) as ll from p where label = truth group by h) select h, round(ll, 6) as ll from l order by ll desc, h limit 1""")
def q_fit_bandwidth(spark, sf_dir):
    """Kernel bandwidth by leave-one-out likelihood."""
    rows = X.signal_vectors(spark, sf_dir).withColumn("mask", F.lit(1))
    prior = rows.groupBy("label").agg(F.count(F.lit(1)).alias("prior"))
    truth = rows.select(F.col("vec_id").alias("q"), F.col("label").alias("truth"))
    widths = (0.15, 0.2, 0.3, 0.4)
    scores = R.class_scores(rows, rows, h=widths, stats=("kernel",)).join(F.broadcast(prior), "label").join(truth, "q")
    own = F.col("label") == F.col("truth")
    joint = [F.col(f"kernel_{k}") * F.col("prior") for k in range(len(widths))]
    per = scores.groupBy("q").agg(*(x for k, j in enumerate(joint) for x in (F.sum(j).alias(f"all_{k}"), F.sum(F.when(own, j)).alias(f"own_{k}"))))
    means = per.agg(*(F.avg(F.log(F.col(f"own_{k}") / (F.col(f"all_{k}") + 1e-30) + 1e-12)).alias(f"ll_{k}") for k in range(len(widths))))
    out = means.select(F.inline(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"ll_{k}").alias("ll")) for k, h in enumerate(widths)))))
    return out.orderBy(F.desc("ll"), "h").limit(1).select("h", F.round("ll", 6).alias("ll"))


THREE = f"""{X.SIGNAL}, {X.split_sql(SEEDS)}, side as (select seed, unit, case when rk <= floor(n * 0.5) then 'g' when rk <= floor(n * 0.5) + floor(n * 0.2) then 'c' else 't' end as side from split),
sims as (select a.seed, a.side, q.vec_id as q, q.label as truth, g.label, list_dot_product(q.e, g.e) as sim from side a join v q on q.unit = a.unit and a.side <> 'g' join side b on b.seed = a.seed and b.side = 'g' join v g on g.unit = b.unit),
sc as (select seed, side, q, truth, label, max(sim) as best from sims group by all), x as (select *, exp({SCALE} * best) as e from sc), p as (select seed, side, q, truth, label, e / sum(e) over (partition by seed, q) as p from x),
nc as (select seed, q, 1 - p as nc from p where side = 'c' and label = truth), r as (select *, row_number() over (partition by seed order by nc, q) - 1 as i, count(*) over (partition by seed) as n from nc),
qh as (select seed, nc as qhat from r where i = ceil(least(1, ceil((n + 1) * 0.9 - 1e-9) / n) * (n - 1) - 1e-9))"""


@query(f"with {THREE}, s as (select seed, q, sum((1 - p <= qhat)::int) as size, bool_or(label = truth and 1 - p <= qhat) as hit from p join qh using (seed) where side = 't' group by all) select seed, round(avg(hit::int), 6) as coverage, round(avg(size), 6) as mean_size, count(*) as n from s group by seed")
def q_conformal_sets(spark, sf_dir):
    """Split-conformal sets at 90 %: gallery, calibration and test units are apart."""
    rows = X.signal_vectors(spark, sf_dir)
    split = S.three_way(rows, "unit", seeds=list(range(SEEDS)))
    def bits(side):
        return F.sum(F.when(F.col("side") == side, S.bit(F.col("seed"))).otherwise(0)).cast("long")
    masks = split.groupBy("unit").agg(bits("gallery").alias("g"), bits("calibration").alias("c"), bits("test").alias("t"))
    rows = rows.join(masks, "unit")
    asked = rows.withColumn("mask", F.col("c").bitwiseOR(F.col("t"))).where("mask > 0")
    scores = staged(R.class_scores(asked, rows.withColumn("mask", F.col("g")), tuple(range(SEEDS)), stats=("best",)), "scores")
    probs = C.softmax(R.exemplar(scores), SCALE)
    seeds = F.explode(F.array(*[F.lit(s) for s in range(SEEDS)]))
    side = rows.select(F.col("vec_id").alias("q"), F.col("label").alias("truth"), "c", "t", seeds.alias("seed"))
    calibration = side.where(F.col("c").bitwiseAND(S.bit(F.col("seed"))) > 0).select("seed", "q", "truth")
    test = side.where(F.col("t").bitwiseAND(S.bit(F.col("seed"))) > 0).select("seed", "q", "truth")
    true = probs.join(calibration, ["seed", "q"]).where("label = truth").select("seed", "q", F.col("p").alias("p_true"))
    sets = C.conformal_sets(probs, C.conformal_threshold(true), test)
    return sets.groupBy("seed").agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("coverage"), F.round(F.avg("size"), 6).alias("mean_size"), F.count(F.lit(1)).alias("n"))


OPEN = f"""{X.SIGNAL}, {X.split_sql(SEEDS)}, sims as (select a.seed, a.unit, q.vec_id as q, q.label as truth, g.label, list_dot_product(q.e, g.e) as sim from split a join v q on q.unit = a.unit and a.is_test join split b on b.seed = a.seed and not b.is_test join v g on g.unit = b.unit and g.label < 8),
bp as (select seed, unit, q, truth, max(sim) as conf, arg_max(label, sim) = any_value(truth) as correct from sims group by seed, unit, q, truth)"""


def _open(spark, sf_dir) -> DataFrame:
    asked, gallery, truth = _sides(X.signal_vectors(spark, sf_dir), SEEDS)
    scores = staged(R.class_scores(asked, gallery.where("label < 8"), tuple(range(SEEDS)), stats=("best",)), "scores")
    best = scores.groupBy("seed", "q").agg(F.min(F.struct((-F.col("best")).alias("b"), "label")).alias("m")).select("seed", "q", (-F.col("m.b")).alias("conf"), F.col("m.label").alias("pred"))
    units = asked.select(F.col("vec_id").alias("q"), "unit")
    return best.join(truth, ["seed", "q"]).join(units, "q").select("seed", "unit", "q", "truth", "conf", (F.col("pred") == F.col("truth")).alias("correct"))


@query(f"""with {OPEN}, pc as (select seed, conf, count(*) as n, sum(correct::int) as c from bp where unit % 2 = 0 and truth < 8 group by seed, conf), cu as (select seed, conf, sum(n) over w as n, sum(c) over w as c from pc window w as (partition by seed order by conf desc rows unbounded preceding)),
th as (select seed, coalesce(min(case when n >= 5 and c >= 0.9 * n then conf end), 1.01) as tau from cu group by seed)
select seed, round(any_value(tau), 6) as tau, round(avg(case when truth >= 8 then (conf < tau)::int end), 6) as oov_rejected, round(avg(case when truth < 8 then (conf < tau)::int end), 6) as known_rejected from bp join th using (seed) where unit % 2 = 1 group by seed""")
def q_open_set_rejection(spark, sf_dir):
    """The operating threshold of half the test units, and what it rejects in the others of known and of absent classes."""
    rows = _open(spark, sf_dir)
    tau = C.operating_threshold(rows.where("unit % 2 = 0 and truth < 8").select("seed", "conf", "correct"))
    other = rows.where("unit % 2 = 1")
    absent = C.reject_rate(other.where("truth >= 8"), tau).withColumnRenamed("rejected", "oov_rejected")
    known = C.reject_rate(other.where("truth < 8"), tau).withColumnRenamed("rejected", "known_rejected")
    return _r(tau.join(absent, "seed").join(known, "seed"), "tau", "oov_rejected", "known_rejected")


@query(f"""with {OPEN}, r as (select seed, truth < 8 as pos, row_number() over (partition by seed order by conf, truth < 8 desc, q) as r from bp)
select seed, round((sum(case when pos then r end) - sum(pos::int) * (sum(pos::int) + 1) / 2) / (sum(pos::int) * sum((not pos)::int)), 6) as auroc from r group by seed""")
def q_ood_auroc(spark, sf_dir):
    rows = _open(spark, sf_dir).select("seed", "q", F.col("conf").alias("score"), (F.col("truth") < 8).alias("positive"))
    return _r(C.auroc(rows), "auroc")
