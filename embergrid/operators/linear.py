"""A linear classifier from moments that add and subtract.

Numbers, sums and squared sums of each class are kept for each fold, so the classifier without a fold is a subtraction and not another fit. The
discriminant of a class is that of equal diagonal covariances: x . (m / v) - m . (m / v) / 2 + ln prior, v the variance within classes.
Everything is one aggregation of the rows; classes and folds, a row each, are sent to the tasks that score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embergrid.functions import vectors as V

LEAST = 1e-9  # added to a variance


def moments(rows: DataFrame, dims: int) -> DataFrame:
    """fold, cls, n, s (sums), q (sums of squares) of rows with fold, cls, e."""
    each = lambda f: F.array(*[F.sum(f(F.col("e")[i])) for i in range(dims)])
    return rows.groupBy("fold", "cls").agg(F.count(F.lit(1)).alias("n"), each(lambda x: x).alias("s"), each(lambda x: x * x).alias("q"))


def _added(m: DataFrame, by: list[str], dims: int) -> DataFrame:
    return m.groupBy(*by).agg(F.sum("n").alias("n"), *(F.array(*[F.sum(F.col(c)[i]) for i in range(dims)]).alias(c) for c in ("s", "q")))


def without_fold(m: DataFrame, dims: int) -> DataFrame:
    """fold, cls, n, s, q of all other folds' rows."""
    total = _added(m, ["cls"], dims).withColumnsRenamed({"n": "_n", "s": "_s", "q": "_q"})
    own = m.select("fold").distinct().crossJoin(total).join(m, ["fold", "cls"], "left")  # folds x classes, both few
    zero = F.array_repeat(F.lit(0.0), dims)
    left = own.select("fold", "cls", (F.col("_n") - F.coalesce("n", F.lit(0))).alias("n"), V.minus(F.col("_s"), F.coalesce("s", zero)).alias("s"), V.minus(F.col("_q"), F.coalesce("q", zero)).alias("q"))
    return left.where("n > 0")


def discriminants(m: DataFrame, dims: int) -> DataFrame:
    """fold, cls, w, b from moments by fold and class."""
    mean = m.withColumn("m", V.scaled(F.col("s"), 1.0 / F.col("n"))).withColumn("inner", F.zip_with("q", F.zip_with("s", "m", lambda s, k: s * k), lambda q, k: q - k))
    pooled = mean.groupBy("fold").agg(F.sum("n").alias("all"), F.array(*[F.sum(F.col("inner")[i]) for i in range(dims)]).alias("inner"))
    rows = mean.drop("inner").join(F.broadcast(pooled.withColumn("v", F.transform("inner", lambda x: x / F.col("all") + LEAST)).drop("inner")), "fold")
    rows = rows.withColumn("w", F.zip_with("m", "v", lambda k, v: k / v))
    return rows.select("fold", "cls", "w", (F.log(F.col("n") / F.col("all")) - V.dot(F.col("m"), F.col("w")) / 2).alias("b"))


def scores(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (with fold, e) for each class of their fold's classifier: cls, score."""
    return rows.join(F.broadcast(found), "fold").withColumn("score", V.dot(F.col("e"), F.col("w")) + F.col("b")).drop("w", "b")
