"""Leak-safe splits by unit. Units are ordered by md5(seed|unit), so that any engine draws the same split."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embergrid.sources.shared import staged

from . import ranking

DRAWS = 1 << 15  # draws of a bootstrap that are made together
TASK_DRAWS = 1 << 22
HELD = 1 << 22  # outcomes that are broadcast


def unit_ranks(rows: DataFrame, unit_col: str, seeds: list[int]) -> DataFrame:
    """seed, unit, rank (from 1), n_units. Works on distinct units: one row for each unit and seed."""
    units = rows.select(F.col(unit_col).alias("unit")).where(F.col(unit_col).isNotNull()).distinct()
    draws = units.select("unit", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    draws = draws.withColumn("key", F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("unit").cast("string"))))
    return ranking.numbered(draws, ["seed"], ranking.by_hash(F.col("key")), [F.col("key"), F.col("unit")]).select("seed", "unit", "rank", F.col("n").alias("n_units"))


def n_test(n: Column, fraction: float) -> Column:
    """At least one; half-even rounding."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(fraction)).cast("int"))


def grouped_split(rows: DataFrame, unit_col: str, fraction: float = 0.3, seeds: list[int] = (0,)) -> DataFrame:
    """seed, unit, is_test."""
    return unit_ranks(rows, unit_col, list(seeds)).select("seed", "unit", (F.col("rank") <= n_test(F.col("n_units"), fraction)).alias("is_test"))


def three_way(rows: DataFrame, unit_col: str, fractions: tuple[float, float] = (0.5, 0.2), seeds: list[int] = (0,)) -> DataFrame:
    """seed, unit, side ('gallery', 'calibration', 'test'); both cuts truncate."""
    ranks = unit_ranks(rows, unit_col, list(seeds))
    a, b = (F.floor(F.col("n_units") * F.lit(f)) for f in fractions)
    side = F.when(F.col("rank") <= a, "gallery").when(F.col("rank") <= a + b, "calibration").otherwise("test")
    return ranks.select("seed", "unit", side.alias("side"))


def folds(rows: DataFrame, unit_col: str, k: int, seed: int = 0) -> DataFrame:
    """unit, fold: whole units in k folds of nearly equal numbers."""
    return unit_ranks(rows, unit_col, [seed]).select("unit", ((F.col("rank") - 1) % k).alias("fold"))


def nested_fractions(rows: DataFrame, unit_col: str, fractions: list[float], seed: int = 0) -> DataFrame:
    """fraction, unit: the first ceil(f n) units (one at least), each set within the next."""
    ranks = unit_ranks(rows, unit_col, [seed]).withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    return ranks.where(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("fraction") * F.col("n_units") - 1e-9))).select("fraction", "unit")


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def masks(rows: DataFrame, unit_col: str, split: DataFrame) -> DataFrame:
    """rows with test_mask: bit s is set where the unit is on the test side of seed s. One shuffle on the unit."""
    bits = split.groupBy("unit").agg(F.sum(F.when(F.col("is_test"), bit(F.col("seed"))).otherwise(0)).cast("long").alias("test_mask"))
    return rows.join(bits, F.col(unit_col) == F.col("unit")).drop("unit") if unit_col != "unit" else rows.join(bits, "unit")


def stratified_sample(rows: DataFrame, category: str, ok: str, key: str, quota: dict[str, int], seed: int = 0) -> DataFrame:
    """Per category its quota, half of it wrong and the rest right, filled up from what is left of either.

    Rows count by the md5 of their key. The quota's first of either kind are found by buckets of digests; what is ordered together is at most twice the quota."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    k = F.create_map(*[F.lit(v) for kv in quota.items() for v in kv])[F.col(category)]
    known = rows.withColumn("_k", k).where(F.col("_k").isNotNull())
    first = ranking.first_of(known.withColumn("_d", order), [category, ok], ranking.by_hash(F.col("_d")), [F.col("_d"), F.col(key)], F.col("_k"))
    half = F.when(F.col(ok), F.col("rank") <= F.col("_k") - F.floor(F.col("_k") / 2)).otherwise(F.col("rank") <= F.floor(F.col("_k") / 2))
    w = W.partitionBy(category).orderBy(F.when(half, 0).otherwise(1), F.col(ok).cast("int"), "rank", key)
    return first.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("_k")).select(*rows.columns)


def _draw_sums(batches: Iterator[pa.RecordBatch], values, seed: int) -> Iterator[pa.RecordBatch]:
    """Sum and number of the outcomes that DRAWS draws of a replicate meet."""
    v, known = values.value
    n = len(v)
    for batch in batches:
        sums, counts, first, ends = [], [], None, []
        for b, j in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
            if j != first:
                first, ends = j, [b"%d" % k for k in range(j, min(j + DRAWS, n))]
            head = b"%d|%d|" % (seed, b)
            digests = b"".join([hashlib.md5(head + k, usedforsecurity=False).digest()[:4] for k in ends])
            at = np.frombuffer(digests, ">u4").astype(np.int64) % n
            sums.append(v[at].sum())
            counts.append(known[at].sum())
        yield pa.record_batch([batch.column(0), pa.array(sums, pa.float64()), pa.array(counts, pa.int64())], names=["replicate", "s", "k"])


def draws(spark: SparkSession, n: int, replicates: int) -> DataFrame:
    """replicate, j: a row for each DRAWS draws, from j on, of a replicate. Dealt out by their number, however few outcomes there are."""
    chunks = -(-n // DRAWS)
    parts = min(replicates * chunks, max(4 * spark.sparkContext.defaultParallelism, n * replicates // TASK_DRAWS))
    rows = spark.range(0, replicates * chunks, 1, max(1, parts))  # one chunk's replicates lie side by side
    return rows.select((F.col("id") % replicates).cast("int").alias("replicate"), (F.expr(f"id div {replicates}") * DRAWS).alias("j"))


def bootstrap_means(rows: DataFrame, key: str, value: str, replicates: int = 2000, seed: int = 0, held: int = HELD) -> DataFrame:
    """replicate, mean: each replicate draws n rows with replacement; draw j of replicate b is row md5(seed|b|j) mod n.

    rows is a table of outcomes, one a test query, numbered by the md5 of its key. Draws are made in tasks that depend on n and the replicates alone;
    up to `held` outcomes (9 bytes each) are broadcast to them. Of more, draws meet their outcomes by number. No task holds a replicate."""
    spark, order = rows.sparkSession, F.md5(F.col(key).cast("string"))
    outcomes = staged(rows.select(key, F.col(value).cast("double").alias("v")), "outcomes")
    n = outcomes.count()
    numbered = ranking.numbered(outcomes, [], ranking.by_hash(order), [order, F.col(key)]).select("v", (F.col("rank") - 1).cast("int").alias("i"))
    if n <= held:
        table = numbered.toArrow()
        v, known = np.zeros(n), np.zeros(n, bool)
        at = table.column("i").to_numpy()
        v[at], known[at] = table.column("v").fill_null(0.0).to_numpy(), table.column("v").is_valid().to_numpy()
        sums = draws(spark, n, replicates).mapInArrow(partial(_draw_sums, values=spark.sparkContext.broadcast((v, known)), seed=seed), "replicate int, s double, k bigint")
        return sums.groupBy("replicate").agg(F.try_divide(F.sum("s"), F.sum("k")).alias("mean"))
    each = draws(spark, n, replicates).select("replicate", F.explode(F.sequence(F.col("j"), F.least(F.col("j") + DRAWS, F.lit(n)) - 1)).alias("j"))
    at = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(n))
    return each.select("replicate", at.cast("int").alias("i")).join(numbered.hint("shuffle_hash"), "i").groupBy("replicate").agg(F.avg("v").alias("mean"))
