"""Metrics over ranked labels, and reports over metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking


def truth_ranks(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per asked query: seed, q, truth, pred, rank_true (null: the label is not in the gallery).

    ranked: seed, q, label, rank. truth: seed, q, truth."""
    top = ranked.groupBy("seed", "q").agg(F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("pred"))
    hit = ranked.join(truth, ["seed", "q"]).where(F.col("label") == F.col("truth")).select("seed", "q", F.col("rank").alias("rank_true"))
    return truth.join(top, ["seed", "q"], "left").join(hit, ["seed", "q"], "left")


def accuracy(ranks: DataFrame, by: tuple[str, ...] = ("seed",)) -> DataFrame:
    """Top-1/3/5 over covered queries, coverage, end-to-end = top-1 * coverage, all in percent."""
    covered = F.col("rank_true").isNotNull()
    top = [(100.0 * F.avg(F.when(covered, (F.col("rank_true") <= k).cast("double")))).alias(f"top{k}") for k in (1, 3, 5)]
    rows = ranks.groupBy(*by).agg(*top, (100.0 * F.avg(covered.cast("double"))).alias("coverage"), F.count(F.lit(1)).alias("n"))
    return rows.withColumn("end_to_end", F.col("top1") * F.col("coverage") / 100.0)


def mean_std(rows: DataFrame, columns: list[str], by: tuple[str, ...] = (), digits: int = 3) -> DataFrame:
    """Mean and population deviation over seeds; NaN and null are skipped."""
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in columns}
    return rows.groupBy(*by).agg(*(x for c in columns for x in (F.round(F.avg(clean[c]), digits).alias(f"{c}_mean"), F.round(F.stddev_pop(clean[c]), digits).alias(f"{c}_std"))))


def paired(a: DataFrame, b: DataFrame, value: str, on: tuple[str, ...] = ("seed",)) -> DataFrame:
    """Mean difference b - a over seeds, and in how many b wins."""
    both = a.select(*on, F.col(value).alias("x")).join(b.select(*on, F.col(value).alias("y")), list(on))
    return both.agg(F.avg(F.col("y") - F.col("x")).alias("delta"), F.count_if(F.col("y") > F.col("x")).alias("wins"), F.count(F.lit(1)).alias("n"))


def verdict(delta: Column, wins: Column, least_wins: int = 7) -> Column:
    return F.when((delta > 0) & (wins >= least_wins), "adopt").otherwise("keep")


def top_counts(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Most common keys; ties by key."""
    return rows.groupBy(*keys).count().orderBy(F.desc("count"), *keys).limit(n)


def symmetric_confusions(errors: DataFrame, least: int = 3) -> DataFrame:
    """Unordered pairs of true and predicted labels with at least `least` errors."""
    pair = errors.select(F.least("truth", "pred").alias("a"), F.greatest("truth", "pred").alias("b"), (F.col("truth") < F.col("pred")).cast("int").alias("up"))
    return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("up").cast("long").alias("a_as_b")).where(F.col("n") >= least)


def support_bucket(n: Column) -> Column:
    return F.least(n, F.lit(4))


def shot_bucket(n: Column) -> Column:
    return F.when(n <= 2, "2").when(n == 3, "3").when(n <= 5, "4-5").otherwise("6+")


def cumulative_coverage(counts: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    """Classes by falling count with the share of rows they cover so far. One row for each class of the vocabulary."""
    rows = ranking.ranged(counts.select(label, F.col(n).alias("_own")), [], [F.desc("_own"), F.col(label)], {"_upto": F.col("_own")})
    total = F.broadcast(counts.agg(F.sum(n).alias("_all")))  # one row
    return rows.drop("n").join(total).select(label, F.col("_own").alias(n), "rank", (F.col("_upto") / F.col("_all")).alias("cum"))


def mode_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key; ties to the smallest."""
    counts = rows.groupBy(key, value).count()
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("count")).alias("c"), value)).alias("m")).select(key, F.col(f"m.{value}").alias(value))


def hubness(near: DataFrame, gallery_ids: DataFrame) -> DataFrame:
    """k-occurrence of each gallery row, zeros too, then mean, deviation, 99th percentile and skew (cubed z with deviation + 1e-9)."""
    occ = gallery_ids.select(F.col("vec_id").alias("g")).join(near.groupBy("g").count(), "g", "left").select("g", F.coalesce("count", F.lit(0)).cast("double").alias("k"))
    stat = occ.agg(F.avg("k").alias("mean"), F.stddev_pop("k").alias("std"), F.max("k").alias("most"), F.percentile("k", F.lit(0.99)).alias("p99"))
    skew = occ.join(F.broadcast(stat)).agg(F.avg(F.pow((F.col("k") - F.col("mean")) / (F.col("std") + 1e-9), F.lit(3.0))).alias("skew"))
    return stat.join(skew)


def choice_gains(log: DataFrame, baseline: float) -> DataFrame:
    """Log of choices - seen and blind (right with and without the image), failed (no reply could be read), listed (the truth was offered) - in percent."""
    share = lambda c: 100.0 * F.avg(c.cast("int"))
    seen, blind = share(F.col("seen") & ~F.col("failed")), share(F.col("blind"))
    columns = {"with_image": seen, "without": blind, "image_gain": seen - blind, "rerank_gain": seen - baseline, "unreadable": share(F.col("failed")), "share_of_ceiling": seen / share(F.col("listed"))}
    return log.agg(F.count(F.lit(1)).alias("asked"), *(F.round(c, 6).alias(k) for k, c in columns.items()))


def label_accounting(raw: DataFrame, vocabulary: DataFrame, valid: Column) -> DataFrame:
    """raw, raw_distinct, kept (in the vocabulary's labels), dropped and dropped_distinct (neither there nor valid)."""
    per = raw.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(vocabulary.select("label").distinct().withColumn("known", F.lit(True)), "label", "left")
    known = F.coalesce("known", F.lit(False))
    gone = ~known & ~valid
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return per.agg(F.sum("n").alias("raw"), F.count(F.lit(1)).alias("raw_distinct"), total(known).alias("kept"), total(gone).alias("dropped"), F.count_if(gone).alias("dropped_distinct"))
