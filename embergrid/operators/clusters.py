"""Spherical k-means within groups, multi-prototypes and k-reciprocal re-ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embergrid.functions import vectors as V
from embergrid.sources.shared import staged


def prototypes(vectors: DataFrame, dims: int, k: int = 3, rounds: int = 8, group: str = "label") -> DataFrame:
    """group, cluster, centre. Groups of at most k rows keep their rows. Starts: the k first rows by md5 of the id; a cluster
    that loses all rows keeps its centre. Each round is one join on the group (k centres each) and one aggregation."""
    order = F.md5(F.col("vec_id").cast("string"))
    first = vectors.groupBy(group).agg(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), "vec_id"))), 1, k).alias("s"), F.count(F.lit(1)).alias("n"))
    starts = first.select(group, "n", F.posexplode("s").alias("cluster", "s")).select(group, "n", "cluster", F.col("s.vec_id").alias("vec_id"))
    centres = staged(starts.join(vectors.select("vec_id", "e"), "vec_id").select(group, "n", "cluster", F.col("e").alias("centre")), "centres")
    rows = vectors.join(first.where(F.col("n") > k).select(group), group, "left_semi").select(group, "vec_id", "e")
    for _ in range(rounds):
        met = rows.join(centres.where(F.col("n") > k), group)
        near = met.groupBy("vec_id").agg(F.min(F.struct((-V.dot(F.col("e"), F.col("centre"))).alias("d"), "cluster")).alias("m")).select("vec_id", "m.cluster")
        mean = rows.join(near, "vec_id").groupBy(group, "cluster").agg(F.array(*[F.avg(F.col("e")[i]) for i in range(dims)]).alias("mean"))
        moved = centres.join(mean, [group, "cluster"], "left").select(group, "n", "cluster", F.when(F.col("mean").isNotNull(), V.unit(F.col("mean"))).otherwise(F.col("centre")).alias("centre"))
        centres = staged(moved, "centres")
    return centres.select(group, "cluster", "centre")


def multi_prototype_scores(queries: DataFrame, centres: DataFrame) -> DataFrame:
    """Best centre of each label; centres are k rows a label."""
    rows = queries.select(F.col("vec_id").alias("q"), "e").join(F.broadcast(centres))
    return rows.groupBy("q", "label").agg(F.max(V.dot(F.col("e"), F.col("centre"))).alias("score"))


def silhouette(rows: DataFrame, dims: int, label: str = "label") -> DataFrame:
    """silhouette, n: mean over rows (label, e) of (b - a) / max(a, b), a and b the mean squared distances to the own class and to the nearest other one; 0 in a class of one row.

    A mean squared distance to a class follows from its number, sum and squared sum, so rows meet one row that holds all classes - a vocabulary - and never each other.
    Null with one class only."""
    sums = rows.groupBy(F.col(label).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("e")[i]) for i in range(dims)]).alias("s"), F.sum(V.dot(F.col("e"), F.col("e"))).alias("q"))
    classes = sums.agg(F.collect_list(F.struct("c", "n", "s", "q")).alias("classes"))
    met = rows.select(F.col(label).alias("own"), "e", V.dot(F.col("e"), F.col("e")).alias("x2")).join(F.broadcast(classes))  # one row
    total = lambda k: k["q"] + k["n"] * F.col("x2") - 2 * V.dot(F.col("e"), k["s"])
    seen = met.select("own", F.transform("classes", lambda k: F.struct(k["c"].alias("c"), k["n"].alias("n"), total(k).alias("t"))).alias("d"))
    mine = F.filter("d", lambda k: k["c"] == F.col("own"))[0]
    near = F.array_min(F.transform(F.filter("d", lambda k: k["c"] != F.col("own")), lambda k: k["t"] / k["n"]))
    both = seen.select(mine["n"].alias("n"), (mine["t"] / F.nullif(mine["n"] - 1, F.lit(0))).alias("a"), near.alias("b"))
    return both.agg(F.avg(F.when(F.col("b").isNull(), None).when(F.col("n") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def reciprocal_weights(near: DataFrame, k1: int = 20, k2: int = 6, lookup: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """i, j, w: k-reciprocal encodings from ranked neighbours.

    near: i, j, rank (0 is the row itself) and d, the distance scaled by j's largest. At least max(k1 + 1, k2) ranks a row.
    Reciprocal sets of k1 neighbours grow by those of members (half of k1, rounded half to even) that overlap by more than two
    thirds; weights exp(-d) sum to one, and are averaged over the k2 first neighbours. A member of a member may stand beyond the
    ranks in near: lookup gives i, j, d of pairs (i, j). Without it such a pair is an error."""
    half = round(k1 / 2)
    def mutual(k):
        n = near.where(F.col("rank") <= k).select("i", "j")
        return n.join(n.select(F.col("i").alias("j"), F.col("j").alias("i")), ["i", "j"])
    wide, narrow = staged(mutual(k1), "wide"), staged(mutual(half), "narrow")
    size = narrow.groupBy(F.col("i").alias("m")).agg(F.count(F.lit(1)).alias("size"))
    steps = wide.select("i", F.col("j").alias("m")).join(narrow.select(F.col("i").alias("m"), F.col("j").alias("c")), "m")
    inside = steps.join(wide.select("i", F.col("j").alias("c")), ["i", "c"]).groupBy("i", "m").agg(F.count(F.lit(1)).alias("k"))
    good = inside.join(size, "m").where(F.col("k") > 2.0 / 3 * F.col("size")).select("i", "m")
    grown = wide.unionByName(steps.join(good, ["i", "m"]).select("i", F.col("c").alias("j"))).distinct()
    known = near.select("i", "j", "d")
    if lookup:
        grown = staged(grown, "grown")
        known = known.unionByName(lookup(grown.join(known, ["i", "j"], "left_anti")).select("i", "j", "d"))
    missing = F.raise_error(F.lit("a member is not among the ranks of near, and there is no lookup"))
    d = grown.join(known, ["i", "j"], "left").select("i", "j", F.exp(-F.coalesce("d", missing)).alias("e"))
    w = d.select("i", "j", (F.col("e") / F.sum("e").over(W.partitionBy("i"))).alias("w"))
    if k2 <= 1:
        return w
    top = near.where(F.col("rank") < k2).select("i", F.col("j").alias("m"))
    return top.join(w.select(F.col("i").alias("m"), "j", "w"), "m").groupBy("i", "j").agg((F.sum("w") / k2).alias("w"))


def reciprocal_distance(weights: DataFrame, asked: DataFrame, distances: DataFrame, lam: float = 0.3, lookup: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """q, g, d: (1 - lam) * Jaccard distance of encodings + lam * scaled distance. distances: q, g, d of the pairs to rank.

    With lookup (i, j, d of pairs (i, j)), all other rows that share a member with the query are ranked too. The k first are then those of
    ranking all rows, if distances has the k nearest of each query: of rows that share nothing, the order is that of d."""
    mine = weights.join(asked.select(F.col("q").alias("i")), "i", "left_semi").select(F.col("i").alias("q"), "j", F.col("w").alias("a"))
    met = mine.join(weights.select(F.col("i").alias("g"), "j", F.col("w").alias("b")), "j").groupBy("q", "g").agg(F.sum(F.least("a", "b")).alias("s"))
    if lookup:
        met = staged(met, "met")
        more = met.where("q <> g").select("q", "g").join(distances, ["q", "g"], "left_anti").select(F.col("q").alias("i"), F.col("g").alias("j"))
        distances = distances.unionByName(lookup(more).select(F.col("i").alias("q"), F.col("j").alias("g"), "d"))
    rows = distances.join(met, ["q", "g"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return rows.select("q", "g", ((1 - lam) * (1 - F.col("s") / (2 - F.col("s") + 1e-12)) + lam * F.col("d")).alias("d"))
