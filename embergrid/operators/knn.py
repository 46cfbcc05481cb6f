"""Exact k-nearest join of two large tables, dealt out by pivots.

A few rows of the gallery are pivots, drawn far apart from a sample. Each query belongs to the cell of its nearest pivot; a cell knows its radius and its norms. Of any gallery row and any
cell the triangle inequality gives the least and the largest distance, and so bounds of the similarity (half of |q|^2 + |g|^2 - d^2). The k + 1 best lower
bounds of a cell - one for the query itself - bound what its queries have at least; rows whose upper bound stays below go nowhere near
that cell. Cells are put together, or cut by hash, into groups of bounded size, and what a group needs of the gallery is cut into blocks of bounded size, so a task
holds one group and one block whatever the data; a vector with any number of copies is only several blocks. On clustered vectors
a row goes to few groups. On vectors without structure nothing can be discarded, and a row goes to all groups: n / block rows of them.

The driver sees a row for each cell or group. Everything else is joined, and only k rows a query leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embergrid.sources.shared import staged

PIVOTS = 1024
DRAWN = 8  # rows of which one becomes a pivot
CELL_ROWS = 4096
BLOCK_BYTES = 32 << 20
TILE = (1024, 4096)
PAIR = "q bigint, g bigint, label bigint, sim double"


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def best_of(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest entries of each row, -inf never; equal ones by id. Ordered by row, then rank."""
    m = min(k, sims.shape[1])
    if not m or not len(sims):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.partition(sims, sims.shape[1] - m, axis=1)[:, -m]
    r, c = np.nonzero((sims >= least[:, None]) & (sims > -np.inf))
    order = np.lexsort((ids[c], -sims[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def _distances(e: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (e * e).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * e @ pivots.T))


def _located(batches: Iterator[pa.RecordBatch], pivots) -> Iterator[pa.RecordBatch]:
    """Queries with their cell, their distance from its pivot and their squared norm."""
    for b in batches:
        if b.num_rows:
            e = matrix(b.column(1))
            d = _distances(e, pivots.value)
            cell = d.argmin(1)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(e)), cell]), pa.array((e * e).sum(1))], names=["q", "e", "cell", "d", "norm"])


def _lower(batches: Iterator[pa.RecordBatch], pivots, radius: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Per cell the `most` best of |g|^2 - (largest distance)^2 in this task."""
    held = np.full((len(radius), 0), -np.inf)
    for b in batches:
        if b.num_rows:
            e = matrix(b.column(2))
            both = np.concatenate([held, ((e * e).sum(1)[:, None] - (_distances(e, pivots.value) + radius) ** 2).T], axis=1)
            held = -np.partition(-both, min(most, both.shape[1]) - 1, axis=1)[:, :most]
    if held.shape[1]:
        cell = np.repeat(np.arange(len(radius), dtype=np.int32), held.shape[1])
        yield pa.record_batch([pa.array(cell), pa.array(held.reshape(-1))], names=["cell", "v"])


def _reach(batches: Iterator[pa.RecordBatch], pivots, cells: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Gallery rows with the groups that may need them."""
    c = cells
    for b in batches:
        if b.num_rows:
            e = matrix(b.column(2))
            norm = (e * e).sum(1)[:, None]
            gap = np.maximum(0.0, _distances(e, pivots.value) - c["radius"] - 1e-7)
            need = (c["high"] + norm - gap**2) / 2 >= c["least"] - 1e-7 * (1 + np.abs(c["least"]))
            group = (need.astype(np.float32) @ c["groups"]) > 0
            r, g = np.nonzero(group)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(r, np.arange(len(e) + 1)), pa.int32()), pa.array(g.astype(np.int32)))
            yield pa.record_batch([*b.columns, lists], names=["g", "label", "e", "groups"])


def _meet(queries: pa.Table, gallery: pa.Table, k: int) -> pa.Table:
    """The k best of one block for each query of one group, tile by tile."""
    schema = pa.schema([("q", pa.int64()), ("g", pa.int64()), ("label", pa.int64()), ("sim", pa.float64())])
    out = []
    if queries.num_rows and gallery.num_rows:
        g, label, e = gallery.column("g").to_numpy(), gallery.column("label").combine_chunks(), matrix(gallery.column("e").combine_chunks())
        ids, asked = queries.column("q").to_numpy(), matrix(queries.column("e").combine_chunks())
        for a in range(0, len(ids), TILE[0]):
            own = ids[a : a + TILE[0]]
            rows, cols, sims = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for b in range(0, len(g), TILE[1]):
                part = asked[a : a + TILE[0]] @ e[b : b + TILE[1]].T
                part[own[:, None] == g[None, b : b + TILE[1]]] = -np.inf
                r, c = best_of(part, g[b : b + TILE[1]], k)
                rows, cols, sims = np.concatenate([rows, r]), np.concatenate([cols, c + b]), np.concatenate([sims, part[r, c]])
            order = np.lexsort((g[cols], -sims, rows))
            rows, cols, sims = rows[order], cols[order], sims[order]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            out.append(pa.table([pa.array(own[rows[keep]]), pa.array(g[cols[keep]]), label.take(pa.array(cols[keep])), pa.array(sims[keep])], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def spread(rows: np.ndarray, n: int) -> np.ndarray:
    """At most n different rows, each the farthest one from those before it."""
    chosen, far = [0], ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


def chained(points: np.ndarray) -> np.ndarray:
    """An order of few points in which each follows the nearest one before it that is left."""
    order, left = [0], np.ones(len(points), bool)
    left[0] = False
    while len(order) < len(points):
        d = np.where(left, ((points - points[order[-1]]) ** 2).sum(1), np.inf)
        order.append(int(d.argmin()))
        left[order[-1]] = False
    return np.array(order)


def grouped(sizes: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each cell: neighbours share a group of at most `most` rows, larger cells have several of their own."""
    first, parts, group, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), -1, 0
    for c in order:
        if sizes[c] > most:
            parts[c] = -(-sizes[c] // most)
            first[c], group, room = group + 1, group + parts[c], 0
        else:
            if sizes[c] > room or group < 0:
                group, room = group + 1, most
            first[c], room = group, room - sizes[c]
    return first, parts


def dealt(queries: DataFrame, gallery: DataFrame, k: int, cell_rows: int = CELL_ROWS, block_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with grp and blk, under which each query meets all that may be among its k nearest. queries: q, e; gallery: g, label, e."""
    spark = queries.sparkSession
    first = gallery.select(F.size("e").alias("n")).first() or queries.select(F.size("e").alias("n")).first()
    dims = first.n if first else 1
    block_rows = block_rows or max(TILE[0], BLOCK_BYTES // (8 * dims))
    wanted = int(min(PIVOTS, max(1, -(-queries.count() // cell_rows))))
    picked = gallery.orderBy(F.xxhash64("g"), "g").limit(DRAWN * wanted).select("e").collect()  # at most DRAWN * PIVOTS rows
    points = spread(np.array([r.e for r in picked], np.float64).reshape(len(picked), -1), wanted) if picked else np.zeros((1, dims))
    pivots, n = spark.sparkContext.broadcast(points), len(points)

    asked = staged(queries.mapInArrow(partial(_located, pivots=pivots), "q bigint, e array<double>, cell int, d double, norm double"), "asked")
    radius, low, high, size = np.zeros(n), np.zeros(n), np.full(n, -np.inf), np.zeros(n, np.int64)
    for r in asked.groupBy("cell").agg(F.max("d").alias("d"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.count(F.lit(1)).alias("n")).collect():
        radius[r.cell], low[r.cell], high[r.cell], size[r.cell] = r.d, r.low, r.high, r.n
    bounds = gallery.mapInArrow(partial(_lower, pivots=pivots, radius=radius, most=k + 1), "cell int, v double")
    bounds = bounds.withColumn("k", F.row_number().over(W.partitionBy("cell").orderBy(F.desc("v")))).where(F.col("k") == k + 1)
    least = np.full(n, -np.inf)
    for r in bounds.collect():
        least[r.cell] = (low[r.cell] + r.v) / 2
    start, parts = grouped(size, chained(points), block_rows)
    groups = np.zeros((n, int((start + parts).max())), np.float32)
    for c in np.flatnonzero(size):
        groups[c, start[c] : start[c] + parts[c]] = 1
    cells = {"radius": radius, "high": high, "least": least, "groups": groups}
    reach = staged(gallery.mapInArrow(partial(_reach, pivots=pivots, cells=cells), "g bigint, label bigint, e array<double>, groups array<int>"), "reach")
    right = reach.select("g", "label", "e", F.explode("groups").alias("grp"))
    blocks = [(r.grp, -(-r.n // block_rows)) for r in reach.select(F.explode("groups").alias("grp")).groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()]
    blocks = F.broadcast(spark.createDataFrame(blocks, "grp int, blocks int"))  # a row for each group
    places = F.broadcast(spark.createDataFrame([(int(c), int(start[c]), int(parts[c])) for c in np.flatnonzero(size)], "cell int, start int, parts int"))
    left = asked.join(places, "cell").select("q", "e", (F.col("start") + F.pmod(F.xxhash64("q"), F.col("parts"))).cast("int").alias("grp"))
    left = left.join(blocks, "grp").select("q", "e", "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
    right = right.join(blocks, "grp").select("g", "label", "e", "grp", F.pmod(F.xxhash64("g", F.lit(1)), F.col("blocks")).cast("int").alias("blk"))
    return left, right


def join(queries: DataFrame, gallery: DataFrame, k: int, **sizes) -> DataFrame:
    """q, g, label, sim, rank: of each query (q, e) the k gallery rows (g, label, e) of the largest dot product, without that of its own id; ties by g."""
    left, right = dealt(queries, gallery, k, **sizes)
    met = left.groupBy("grp", "blk").cogroup(right.groupBy("grp", "blk")).applyInArrow(lambda a, b: _meet(a, b, k), PAIR)
    return met.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim"), "g"))).where(F.col("rank") <= k)


def _stream(batches: Iterator[pa.RecordBatch], classes, k: int) -> Iterator[pa.RecordBatch]:
    labels, table = classes.value
    for b in batches:
        for a in range(0, b.num_rows, TILE[0]):
            part = b.slice(a, TILE[0])
            sims = matrix(part.column(1)) @ table.T
            r, c = best_of(sims, labels, k)
            rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
            yield pa.record_batch([part.column(0).take(pa.array(r)), pa.array(labels[c]), pa.array(sims[r, c]), pa.array(rank.astype(np.int32))], names=["q", "label", "sim", "rank"])


def best_classes(queries: DataFrame, classes: DataFrame, k: int, most: int = CELL_ROWS) -> DataFrame:
    """q, label, sim, rank: the k classes (label, e) of the largest dot product with each query (q, e), ties to the smaller label.

    Up to `most` classes are sent to all tasks and queries stream past, k rows each leaving; a larger vocabulary is joined by pivots."""
    q = queries.select(F.col("q").cast("long").alias("q"), F.col("e").cast("array<double>").alias("e"))
    c = classes.select(F.col("label").cast("long").alias("label"), F.col("e").cast("array<double>").alias("e"))
    few = c.limit(most + 1).toArrow()
    if few.num_rows <= most:
        table = few.column("label").to_numpy(), matrix(few.column("e").combine_chunks())
        if not few.num_rows:
            return queries.sparkSession.createDataFrame([], "q long, label long, sim double, rank int")
        return q.mapInArrow(partial(_stream, classes=queries.sparkSession.sparkContext.broadcast(table), k=k), "q bigint, label bigint, sim double, rank int")
    # a query's number must not be taken for the class of that number: queries get numbers that no class has
    met = join(q.select((-2 - 2 * F.col("q")).alias("q"), "e"), c.select((2 * F.col("label") + 1).alias("g"), "label", "e"), k)
    return met.select(((-2 - F.col("q")) / 2).cast("long").alias("q"), "label", "sim", "rank")
