"""Row numbers over whole groups without one task that orders a group.

Rows go to buckets that are in the order asked for; each bucket is ordered by itself, and starts after the counts of those
before it. Only the counts, at most BUCKETS rows a group, are ordered as a whole. Where no bucket is known beforehand, ranges drawn by the
engine take their place (``ranged``): a row for each range and group is ordered as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embergrid.sources.shared import staged

BUCKETS = 4096


def by_hash(text: Column) -> Column:
    """Bucket of a hexadecimal digest, in the digests' order."""
    return F.conv(F.substring(text, 1, 3), 16, 10).cast("int")


def by_share(value: Column) -> Column:
    """Bucket of a number from 0 to 1, in the numbers' order (others fall in the outermost)."""
    return F.least(F.greatest(F.floor(value * BUCKETS), F.lit(-1)), F.lit(BUCKETS)).cast("int")


def numbered(rows: DataFrame, by: list[str], bucket: Column, order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """rows with rank (from 1), n (rows of the group) and running sums in the order `order`, which `bucket` must not contradict.

    rows is read twice: give a table where making it is dear."""
    sums = sums or {}
    cut = rows.withColumn("_b", bucket)
    per = cut.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_s_{k}") for k, c in sums.items()))
    before = W.partitionBy(*by).orderBy("_b")
    starts = per.select(*by, "_b", (F.sum("_n").over(before) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy(*by)).alias("n"), *((F.sum(f"_s_{k}").over(before) - F.col(f"_s_{k}")).alias(f"_s_{k}") for k in sums))
    own = W.partitionBy(*by, "_b").orderBy(*order)
    cut = cut.withColumns({"_r": F.row_number().over(own)} | {k: F.sum(c).over(own.rowsBetween(W.unboundedPreceding, 0)) for k, c in sums.items()})
    met = cut.join(starts, [*by, "_b"])
    return met.select(*rows.columns, (F.col("_before") + F.col("_r")).alias("rank"), "n", *((F.col(f"_s_{k}") + F.col(k)).alias(k) for k in sums))


def ranged(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """As numbered, for any order: rows are dealt out by ranges of (by, order) and written, so that the ranges stay as they are."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    return numbered(dealt, by, F.col("_range"), order, sums).drop("_range")


def first_of(rows: DataFrame, by: list[str], bucket: Column, order: list[Column], most: Column) -> DataFrame:
    """numbered, but only the rows whose rank is `most` (a column of rows, one value a group) or less: buckets that begin after are never ordered."""
    cut = rows.withColumns({"_b": bucket, "_most": most})
    per = cut.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"), F.max("_most").alias("_most"))
    starts = per.withColumn("_before", F.sum("_n").over(W.partitionBy(*by).orderBy("_b")) - F.col("_n")).where(F.col("_before") < F.col("_most")).select(*by, "_b", "_before")
    met = cut.join(starts, [*by, "_b"])
    met = met.withColumn("rank", F.col("_before") + F.row_number().over(W.partitionBy(*by, "_b").orderBy(*order)))
    return met.where(F.col("rank") <= F.col("_most")).select(*rows.columns, "rank")
