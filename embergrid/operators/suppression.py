"""Greedy suppression in a given order: a point stays unless one that stays, of the same group and earlier, is within |dx| < d and |dy| < d.

Small groups fold in one expression. Groups of more than `fold_rows` points are settled in rounds over cells of side d, so no task holds a group:
two points of one cell are always near, so at most one of a cell stays. In each round the first open point of a cell stays if no earlier open point is near it
(it cannot be near one that stays: it would be gone); then all open points near it go. A round reads the open points once; the first one of every group is settled in
each, and of points in no particular order most cells are within a few.

Points without coordinates stay and suppress nothing. Equal rows count once. Rounds are tables in the shared folder; those no longer read are deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embergrid.sources.shared import Scratch

FOLD_ROWS = 1000


def _near(x: Column, y: Column, u: Column, v: Column, d: float) -> Column:
    return (F.abs(x - u) < d) & (F.abs(y - v) < d)


def folded(items: DataFrame, d: float) -> DataFrame:
    """_g, _o of the rows that stay: an exact fold in order for each group."""
    def step(kept, p):
        return F.when(F.exists(kept, lambda k: _near(k["x"], k["y"], p["x"], p["y"], d)), kept).otherwise(F.concat(kept, F.array(p)))
    rows = items.groupBy("_g").agg(F.array_sort(F.collect_set("_o")).alias("_p"))
    rows = rows.withColumn("_k", F.aggregate(F.slice("_p", F.lit(2), F.size("_p")), F.slice("_p", F.lit(1), F.lit(1)), step))
    return rows.select("_g", F.explode("_k").alias("_o"))


def _around(rows: DataFrame, item: str) -> DataFrame:
    """Each row once for each of the nine cells around its own."""
    beside = F.array(*[F.struct((F.col("_u") + i).alias("_u"), (F.col("_v") + j).alias("_v")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return rows.select("_g", F.col(item).alias("_a"), F.explode(beside).alias("_c")).select("_g", "_a", "_c._u", "_c._v")


def in_rounds(items: DataFrame, d: float) -> DataFrame:
    """items: _g (a struct, so that nulls in it are equal) and _o. Those that stay, as folded gives them, for groups of any size."""
    scratch, cell = Scratch(items.sparkSession), ["_g", "_u", "_v"]
    open_rows = scratch.table(items.withColumns({"_u": F.floor(F.col("_o.x") / d), "_v": F.floor(F.col("_o.y") / d)}), "open")
    near = _near(F.col("_o.x"), F.col("_o.y"), F.col("_a.x"), F.col("_a.y"), d)
    stay = []
    while True:
        first = open_rows.groupBy(*cell).agg(F.min("_o").alias("_first"))
        # at most nine rows meet a cell's points, and where a cell has very many the engine splits the side of the points
        blocked = open_rows.join(_around(first, "_first"), cell).where(near & (F.col("_o") < F.col("_a"))).select("_g", F.col("_a").alias("_first")).distinct()
        settled = scratch.table(first.join(blocked, ["_g", "_first"], "left_anti"), "stay")
        stay.append(settled.select("_g", F.col("_first").alias("_o")))
        gone = _around(settled, "_first").withColumnsRenamed({c: f"_k{c}" for c in cell})
        same = reduce(Column.__and__, [F.col(c) == F.col(f"_k{c}") for c in cell])
        open_rows = scratch.table(open_rows.join(gone, same & near, "left_anti"), "open")
        scratch.drop_but_last("open")
        if open_rows.isEmpty():
            return reduce(DataFrame.unionByName, stay)


def greedy(rows: DataFrame, by: list[str], order: list[str], d: float, extra: tuple[str, ...] = (), fold_rows: int = FOLD_ROWS) -> DataFrame:
    """by, obs_id, x, y and the extra columns of the points that stay. Order: `order`, then x, y, obs_id and extra columns."""
    item = F.struct(*order, "x", "y", F.col("obs_id").alias("id"), *(F.col(c).alias(f"_{c}") for c in extra))
    items = rows.select(F.struct(*by).alias("_g"), item.alias("_o"))
    placed = F.col("_o.x").isNotNull() & F.col("_o.y").isNotNull()
    large = items.where(placed).groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > fold_rows).select("_g")
    if large.isEmpty():
        out = folded(items, d)
    else:
        large = Scratch(rows.sparkSession).table(large, "large")
        those = items.join(large, "_g", "left_semi")
        out = reduce(DataFrame.unionByName, [folded(items.join(large, "_g", "left_anti"), d), in_rounds(those.where(placed), d), those.where(~placed).distinct()])
    return out.select("_g.*", F.col("_o.id").alias("obs_id"), "_o.x", "_o.y", *(F.col(f"_o._{c}").alias(c) for c in extra))
