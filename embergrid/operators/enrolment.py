"""Classes that are enrolled step by step: a table of mergeable states.

A step writes what its rows add - a row a class: number and sum of vectors - under its own version and reads nothing that was there before. A state is the
sum of all versions up to one; its means are the classes' prototypes. Steps may be enrolled in any order and any number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.functions import vectors as V

from . import knn


def enrol(rows: DataFrame, target: str, version: int, dims: int) -> None:
    """Add rows (label, e) to the states under target. A version is written once: a second writer of the same one fails."""
    good = rows.where("label is not null and e is not null")
    sums = good.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("e")[i]) for i in range(dims)]).alias("total"))
    sums.write.mode("errorifexists").parquet(f"{target}/version={int(version)}")


def state(spark: SparkSession, target: str, dims: int, upto: int | None = None) -> DataFrame:
    """label, n, total of all versions (up to `upto`): one small row a class and version is read."""
    parts = spark.read.schema("label bigint, n bigint, total array<double>, version int").parquet(target)
    parts = parts if upto is None else parts.where(F.col("version") <= upto)
    return parts.groupBy("label").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total"))


def prototypes(states: DataFrame, least: int = 1) -> DataFrame:
    """label, e: the unit mean of each class that has `least` rows."""
    return states.where(F.col("n") >= least).select("label", V.unit(V.scaled(F.col("total"), 1.0 / F.col("n"))).alias("e"))


def summary(states: DataFrame, least: int = 1) -> DataFrame:
    """n_support, n_classes_seen, filled: rows enrolled, classes with any, classes with a prototype."""
    return states.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_support"), F.count(F.lit(1)).alias("n_classes_seen"), F.count_if(F.col("n") >= least).alias("filled"))


def nearest_class(queries: DataFrame, classes: DataFrame, k: int = 1) -> DataFrame:
    """q, label, sim, rank: the k classes of the largest cosine for each query (q, e: unit vectors). Classes: label, e; a vocabulary of any size."""
    met = knn.best_classes(queries, classes, k)
    return met.select("q", "label", "sim", "rank")
