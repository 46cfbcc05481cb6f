"""Probabilities, calibration and decisions over score tables (seed, q, label, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embergrid.sources.shared import staged

from . import ranking

GRID = [round(0.05 * k, 2) for k in range(1, 21)]


def softmax(scores: DataFrame, scale: float | Column = 1.0, by: tuple[str, ...] = ("seed", "q")) -> DataFrame:
    w = W.partitionBy(*by)
    s = F.col("score") * scale
    rows = scores.withColumn("_e", F.exp(s - F.max(s).over(w)))
    return rows.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def confidences(probs: DataFrame, truth: DataFrame) -> DataFrame:
    """seed, q, conf (largest p), pred (ties to the smallest label), correct, p_true; only queries whose label is in the gallery."""
    best = probs.groupBy("seed", "q").agg(F.max("p").alias("conf"), F.min(F.struct((-F.col("p")).alias("x"), "label")).alias("b"))
    true = probs.join(truth, ["seed", "q"]).where(F.col("label") == F.col("truth")).select("seed", "q", "truth", F.col("p").alias("p_true"))
    return best.join(true, ["seed", "q"]).select("seed", "q", "conf", F.col("b.label").alias("pred"), (F.col("b.label") == F.col("truth")).alias("correct"), "p_true", "truth")


def fit_scale(loo_scores: DataFrame, truth: DataFrame, grid: list[float], default: float = 15.0) -> DataFrame:
    """Per seed the scale of least mean negative log-likelihood; ties to the smaller."""
    rows = loo_scores.withColumn("s", F.explode(F.array(*[F.lit(float(s)) for s in grid])))
    probs = softmax(rows, F.col("s"), ("seed", "q", "s"))
    true = probs.join(truth, ["seed", "q"]).where(F.col("label") == F.col("truth"))
    nll = true.groupBy("seed", "s").agg(F.avg(-F.log(F.col("p") + 1e-12)).alias("nll"))
    return nll.groupBy("seed").agg(F.min(F.struct("nll", "s")).alias("b")).select("seed", F.coalesce("b.s", F.lit(default)).alias("scale"), F.col("b.nll").alias("nll"))


def _score_lists(rows: DataFrame) -> DataFrame:
    """seed, q, xs (scores less their maximum), xt (that of the true label) of rows seed, q, label, score, truth; labels that are not among the scores are left out."""
    per = rows.groupBy("seed", "q").agg(F.collect_list("score").alias("xs"), F.max(F.when(F.col("label") == F.col("truth"), F.col("score"))).alias("xt"), F.max("score").alias("top"))
    return per.where("xt is not null").select("seed", "q", F.transform("xs", lambda x: x - F.col("top")).alias("xs"), (F.col("xt") - F.col("top")).alias("xt"))


def fit_temperature(rows: DataFrame, low: float = 1.0, high: float = 60.0, steps: tuple[float, ...] = (1.0, 0.05, 0.0025), reach: int = 20) -> DataFrame:
    """seed, scale, nll: the scale of least mean negative log-likelihood; rows as in _score_lists.

    All candidates of a pass are tried in one aggregation: the whole range in the first step's width, then `reach` finer steps to either side of the best. A query is one row
    with its scores and becomes one number for each candidate, added up where it is. Ties go to the smaller scale."""
    lists = staged(_score_lists(rows), "score_lists")
    count = int(round((high - low) / steps[0])) + 1
    base = lists.select("seed").distinct().select("seed", F.lit(low).alias("start"))
    for n, step in enumerate(steps):
        candidates = base.select("seed", F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.round(F.col("start") + k * step, 6))).alias("s"))
        total = F.aggregate("xs", F.lit(0.0), lambda a, x: a + F.exp(F.col("s") * x))
        loss = -F.log(F.exp(F.col("s") * F.col("xt")) / total + 1e-12)
        best = lists.join(F.broadcast(candidates), "seed").groupBy("seed", "s").agg(F.avg(loss).alias("nll")).groupBy("seed").agg(F.min(F.struct(F.round("nll", 12).alias("r"), "s", "nll")).alias("m"))
        best = staged(best.select("seed", F.col("m.s").alias("scale"), F.col("m.nll").alias("nll")), "scales")  # a row a seed
        if n + 1 < len(steps):
            count = 2 * reach + 1
            base = best.select("seed", F.greatest(F.lit(low), F.col("scale") - reach * steps[n + 1]).alias("start"))
    return best


def fuse(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Product of experts over two tables of p."""
    both = a.join(b.select("seed", "q", "label", F.col("p").alias("p2")), ["seed", "q", "label"])
    return softmax(both.select("seed", "q", "label", (alpha * F.log("p") + beta * F.log("p2")).alias("score")))


def decide(probs: DataFrame, least_p: float = 0.40, most_bits: float = 2.5, top: int = 5) -> DataFrame:
    """pred, prob, entropy_bits, abstain, topk."""
    w = W.partitionBy("seed", "q").orderBy(F.desc("p"), "label")
    rows = probs.withColumn("_r", F.row_number().over(w))
    out = rows.groupBy("seed", "q").agg(
        F.max(F.when(F.col("_r") == 1, F.col("label"))).alias("pred"), F.max("p").alias("prob"),
        F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log2("p")).otherwise(0.0)).alias("entropy_bits"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= top, F.struct("_r", "label")))), lambda x: x["label"]).alias("topk"),
    )
    return out.withColumn("abstain", (F.col("prob") < least_p) | (F.col("entropy_bits") > most_bits))


def ece(conf: DataFrame, bins: int = 15, first_closed: bool = True, by: tuple[str, ...] = ("seed",)) -> DataFrame:
    """Expected calibration error. Bins are (b / n, (b + 1) / n]; conf = 0 falls in the first, or in none."""
    b = F.ceil(F.col("conf") * bins)
    b = F.greatest(b, F.lit(1)) if first_closed else F.when(b >= 1, b)
    rows = conf.withColumn("_b", b).withColumn("_c", F.col("correct").cast("double"))
    per = rows.groupBy(*by, "_b").agg(F.avg("_c").alias("acc"), F.avg("conf").alias("conf"), F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    gap = F.when(F.col("_b").isNotNull(), F.abs(F.col("acc") - F.col("conf")) * F.col("n")).otherwise(0.0)
    return per.groupBy(*by).agg((F.sum(gap) / total).alias("ece"))


def ordered(conf: DataFrame) -> DataFrame:
    """Most confident first: rank, n and the running accuracy; ties by q. Confidences lie from 0 to 1 and are ordered by buckets."""
    rows = ranking.numbered(staged(conf, "outcomes"), ["seed"], -ranking.by_share(F.col("conf")), [F.desc("conf"), F.col("q")], {"right": F.col("correct").cast("double")})
    return rows.withColumn("running", F.col("right") / F.col("rank")).drop("right")


def risk_coverage(conf: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """seed, coverage, accuracy at each grid point; the cut rounds half to even, one query at least."""
    rows = ordered(conf).withColumn("coverage", F.explode(F.array(*[F.lit(g) for g in grid])))
    return rows.where(F.col("rank") == F.greatest(F.lit(1), F.bround(F.col("coverage") * F.col("n")).cast("int"))).select("seed", "coverage", F.col("running").alias("accuracy"))


def interpolate(curve: DataFrame, x: float) -> DataFrame:
    """Linear interpolation of accuracy at coverage x."""
    w = W.partitionBy("seed").orderBy("coverage")
    rows = curve.select("seed", F.col("coverage").alias("x1"), F.col("accuracy").alias("y1"), F.lag("coverage").over(w).alias("x0"), F.lag("accuracy").over(w).alias("y0"))
    return rows.where((F.col("x1") >= x) & (F.coalesce("x0", F.lit(-1.0)) < x)).select("seed", F.when(F.col("x0").isNull(), F.col("y1")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (x - F.col("x0")) / (F.col("x1") - F.col("x0"))).alias("value"))


def coverage_at(curve: DataFrame, target: float) -> DataFrame:
    return curve.groupBy("seed").agg(F.coalesce(F.max(F.when(F.col("accuracy") >= target, F.col("coverage"))), F.lit(0.0)).alias("coverage"))


def aurc(conf: DataFrame) -> DataFrame:
    return ordered(conf).groupBy("seed").agg(F.avg(1 - F.col("running")).alias("aurc"))


def auroc(rows: DataFrame, by: tuple[str, ...] = ("seed",)) -> DataFrame:
    """score, positive -> area by ordinal ranks; equal scores: positives first. Null with one class only.

    Rows are counted by score first; the distinct scores are ordered by ranges."""
    per = rows.groupBy(*by, "score").agg(F.count_if("positive").alias("p"), F.count(F.lit(1)).alias("k"))
    per = ranking.ranged(per, list(by), [F.col("score")], {"upto": F.col("k")})
    r = per.withColumn("ranks", F.col("p") * (F.col("upto") - F.col("k")) + F.col("p") * (F.col("p") + 1) / 2)
    n1, n0 = F.sum("p"), F.sum(F.col("k") - F.col("p"))
    return r.groupBy(*by).agg(F.when((n1 > 0) & (n0 > 0), (F.sum("ranks") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auroc"))


def conformal_threshold(calibration: DataFrame, alpha: float = 0.1) -> DataFrame:
    """seed, qhat: the 'higher' quantile of 1 - p_true at min(1, ceil((n + 1)(1 - alpha)) / n)."""
    rows = staged(calibration.select("seed", "q", (1 - F.col("p_true")).alias("nc")), "scores")
    rows = ranking.numbered(rows, ["seed"], ranking.by_share(F.col("nc")), [F.col("nc"), F.col("q")]).withColumn("i", F.col("rank") - 1)
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * (1 - alpha) - 1e-9) / F.col("n"))
    return rows.where(F.col("i") == F.ceil(level * (F.col("n") - 1) - 1e-9)).select("seed", F.col("nc").alias("qhat"))


def conformal_sets(probs: DataFrame, qhat: DataFrame, truth: DataFrame) -> DataFrame:
    """seed, q, size, hit: labels with 1 - p <= qhat."""
    rows = probs.join(F.broadcast(qhat), "seed").join(truth, ["seed", "q"])
    inside = (1 - F.col("p")) <= F.col("qhat")
    return rows.groupBy("seed", "q").agg(F.count_if(inside).alias("size"), F.coalesce(F.bool_or(inside & (F.col("label") == F.col("truth"))), F.lit(False)).alias("hit"))


def threshold_sweep(conf: DataFrame, thresholds: list[float]) -> DataFrame:
    rows = conf.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    kept = F.col("conf") >= F.col("threshold")
    return rows.groupBy("seed", "threshold").agg(F.avg(kept.cast("double")).alias("coverage"), F.avg(F.when(kept, F.col("correct").cast("double"))).alias("accuracy"))


def operating_threshold(conf: DataFrame, target: float = 0.9, least: int = 5, none: float = 1.01) -> DataFrame:
    """Smallest confidence with at least `least` answers at or above it and accuracy >= target there."""
    per = conf.groupBy("seed", "conf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("c"))
    rows = ranking.numbered(staged(per.withColumnsRenamed({"n": "own", "c": "right"}), "confidences"), ["seed"], -ranking.by_share(F.col("conf")), [F.desc("conf")], {"upto": F.col("own"), "c": F.col("right")})
    rows = rows.select("seed", "conf", F.col("upto").alias("n"), "c")
    return rows.groupBy("seed").agg(F.coalesce(F.min(F.when((F.col("n") >= least) & (F.col("c") >= target * F.col("n")), F.col("conf"))), F.lit(none)).alias("tau"))


def reject_rate(conf: DataFrame, tau: DataFrame) -> DataFrame:
    return conf.join(F.broadcast(tau), "seed").groupBy("seed").agg(F.avg((F.col("conf") < F.col("tau")).cast("double")).alias("rejected"))


def margins(probs: DataFrame) -> DataFrame:
    """seed, q, margin between the two best."""
    return probs.groupBy("seed", "q").agg(F.slice(F.sort_array(F.collect_list("p"), False), 1, 2).alias("t")).select("seed", "q", (F.col("t")[0] - F.coalesce(F.get("t", F.lit(1)), F.lit(0.0))).alias("margin"))
