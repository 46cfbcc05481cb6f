"""Scoring of a stated query set against a gallery, in blocks.

Up to BLOCK queries are broadcast as one matrix and the gallery streams past it. More queries are dealt out on Spark: both sides are cut
into blocks, and each pair of blocks meets in a task of its own. The work is one matrix product for each Arrow batch, and only
partial results (a row per query and label, or the k nearest) are shuffled. Nothing emits all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, partial, reduce
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from embergrid.functions import vectors as V
from embergrid.sources.shared import stage_path

from . import knn
from .knn import matrix as _matrix

BLOCK = 2048
TILES = 32  # of BLOCK rows in a cell, at most
STATS = {"best": "double", "total": "double", "n": "bigint", "soft": "double", "kernel": "double"}
TASKS = 4  # pairs of cells for each core, at least
SPREAD = 8  # partitions for each pair of cells, so that few pairs share one
STEP, FEW = 512, 16  # queries whose products are held at a time, where a batch has few labels
PIECE, LEAST = 512, 128  # gallery rows and queries of a piece, where only sums are asked for
SPAN = 8192  # gallery rows of one label that are looked through at a time, where only the best is asked for
LANE, WIDE = 16, 2048  # columns whose largest product is kept; twice as many where there are more than WIDE
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
NEAR = "seed int, q bigint, g bigint, label bigint, sim double"


def _block(rows: pa.Table, names: list[str]) -> dict:
    """Columns of queries as arrays, vectors as a matrix."""
    columns = {c: rows.column(k).to_numpy() for k, c in enumerate(names)}
    return columns | {"e": np.stack(columns["e"]).astype(np.float64)}


def _cell(queries: pa.Table, gallery: pa.Table, fn, names: list[str], schema: pa.Schema, tile: int, ready=None, whole: bool = False) -> pa.Table:
    """fn for one pair of cells, `tile` queries and two tiles of gallery rows (whole: all) at a time. What `ready` makes of gallery rows is made once, not for each tile of queries."""
    if not queries.num_rows or not gallery.num_rows:
        return schema.empty_table()
    columns = [c for c in gallery.column_names if c not in ("_q", "_g", "_s")]
    if "label" in columns and not whole:
        gallery = gallery.take(np.argsort(gallery.column("label").to_numpy(), kind="stable"))  # few labels in a batch
    batches = gallery.select(columns).combine_chunks().to_batches(max_chunksize=gallery.num_rows if whole else 2 * tile)
    if ready:
        batches = [ready(b) for b in batches]
    tiles = [SimpleNamespace(value=_block(queries.select(names).slice(k, tile).combine_chunks(), names)) for k in range(0, queries.num_rows, tile)]
    return pa.Table.from_batches([x for t in tiles for x in fn(iter(batches), block=t)], schema)


def _allowed(b: dict, g: np.ndarray, units: np.ndarray, other_unit: bool) -> np.ndarray:
    """Self is never a neighbour; with other_unit, nor is the own unit."""
    return (b["unit"][:, None] != units[None, :]) if other_unit else (b["q"][:, None] != g[None, :])


def _forbidden(own: np.ndarray, theirs: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, gallery row) of equal keys; `order` sorts theirs."""
    order = np.argsort(theirs, kind="stable") if order is None else order
    first, past = (np.searchsorted(theirs, own, side, sorter=order) for side in ("left", "right"))
    k = past - first
    r = np.repeat(np.arange(len(own)), k)
    return r, order[np.arange(len(r)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first, k)]


def _summed(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Sums of each row over the columns of each seed. Entries without a number count under their own seeds only."""
    out = x @ bits
    return out if np.isfinite(out).all() else np.stack([x[:, bits[:, k] > 0].sum(1) for k in range(bits.shape[1])], 1)


def _raise_best(held: np.ndarray, sims: np.ndarray, asked: np.ndarray, bits: np.ndarray, turns: int = 4) -> None:
    """Raise held (a row a query, a column a seed) to the largest similarity among the gallery rows of each seed.

    A query's largest entry settles all seeds that its gallery row belongs to, the next one the rest; queries that have better already are passed over. What is open after
    some turns is looked up seed by seed."""
    asked = asked & bits.any(0)
    rows = np.flatnonzero((asked & ~(held >= sims.max(1)[:, None])).any(1))
    part, todo, best = sims[rows], asked[rows], held[rows]
    for _ in range(turns):
        if not len(rows):
            return
        at = part.argmax(1)
        each = np.arange(len(rows))
        value = part[each, at]
        todo &= ~(best >= value[:, None])
        hit = todo & bits[at]
        best = np.where(hit, value[:, None], best)
        held[rows] = best
        todo &= ~hit
        part[each, at] = -np.inf
        left = np.flatnonzero(todo.any(1))
        rows, part, todo, best = rows[left], part[left], todo[left], best[left]
    for s in np.flatnonzero(todo.any(0)):
        mine = np.flatnonzero(todo[:, s])
        held[rows[mine], s] = np.maximum(best[mine, s], part[np.ix_(mine, np.flatnonzero(bits[:, s]))].max(1))


def _longest(e: np.ndarray) -> float:
    return np.sqrt((e * e).sum(1)).max(initial=0.0)


def _slack(queries: np.ndarray, most: float) -> np.ndarray | None:
    """For each query a bound of the error of its 32-bit products with vectors of length `most`; None for vectors that 32 bits may not hold."""
    own = np.sqrt((queries * queries).sum(1))
    if not (most < 1e15 and (own < 1e15).all()):  # nor for what is no number
        return None
    return (queries.shape[1] + 8) * 2.0**-23 * own * most + 1e-30


def _rounded(queries: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Both sides in 32 bits, and the bounds of _slack."""
    slack = _slack(queries, _longest(e))
    return None if slack is None else (queries.astype(np.float32), e.astype(np.float32), slack)


def _raise_rounded(held: np.ndarray, part: np.ndarray, slack: np.ndarray, q: np.ndarray, e: np.ndarray, asked: np.ndarray, bits: np.ndarray, names: tuple[np.ndarray, ...] = (), kept: tuple[np.ndarray, ...] = (), turns: int = 64) -> None:
    """As _raise_best, from products in 32 bits (-inf: not permitted; spoilt) that are off by `slack` at most; held gets products in 64 bits.

    A row's largest entries are worked out in full one after the other, until no seed's best can be among the rest; rows that are open after some turns are worked out as
    a whole. `kept` gets the numbers `names` of the gallery rows found; equal ones go by the first of them."""
    deep = LANE if part.shape[1] <= WIDE else 2 * LANE
    lanes = -(-part.shape[1] // deep)  # a lane: each lanes-th column, so that largest entries of all lanes are found side by side
    tops = part[:, :lanes].copy()
    for k in range(lanes, part.shape[1], lanes):
        some = part[:, k : k + lanes]
        np.maximum(tops[:, : some.shape[1]], some, out=tops[:, : some.shape[1]])
    rows = np.flatnonzero((asked & (held <= (tops.max(1) + slack)[:, None])).any(1))
    tops = tops[rows]

    def settle(rows, seeds, value, columns):
        old = held[rows, seeds]
        better = (value > old) | ((value == old) & (names[0][columns] < kept[0][rows, seeds])) if names else value > old
        rows, seeds, columns = rows[better], seeds[better], columns[better]
        held[rows, seeds] = value[better]
        for x, name in zip(kept, names, strict=True):
            x[rows, seeds] = name[columns]

    for _ in range(turns):
        if not len(rows):
            return
        lane = tops.argmax(1)
        most = tops[np.arange(len(rows)), lane] + slack[rows]
        todo = asked[rows] & (held[rows] <= most[:, None]) & (most > -np.inf)[:, None]
        left = np.flatnonzero(todo.any(1))
        rows, lane, todo, tops = rows[left], lane[left], todo[left], tops[left]
        columns = lane[:, None] + lanes * np.arange(deep)
        columns = np.where(columns < part.shape[1], columns, lane[:, None])
        some = part[rows[:, None], columns]
        at = columns[np.arange(len(rows)), some.argmax(1)]
        r, k = np.nonzero(todo & bits[at])
        settle(rows[r], k, np.einsum("ij,ij->i", q[rows], e[at])[r], at[r])
        part[rows, at] = -np.inf
        tops[np.arange(len(rows)), lane] = np.where(columns == at[:, None], -np.inf, some).max(1)
    sims = np.where(part[rows] > -np.inf, q[rows] @ e.T, -np.inf)
    for s in np.flatnonzero(asked[rows].any(0) & bits.any(0)):
        mine, columns = np.flatnonzero(asked[rows, s]), np.flatnonzero(bits[:, s])
        r, c = knn.best_of(sims[np.ix_(mine, columns)], names[0][columns] if names else columns, 1)
        settle(rows[mine[r]], np.full(len(r), s), sims[mine[r], columns[c]], columns[c])


def _spans(label: np.ndarray) -> list[tuple[int, int, int]]:
    """Labels that are in order, with first and end of their rows."""
    cuts = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1], [True]]))
    return list(zip(label[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


class _Rows:
    """Gallery rows in the order of their labels, with all that does not depend on the queries that meet them."""

    def __init__(self, batch: pa.RecordBatch, seeds: tuple[int, ...]):
        g, label, units, mask = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(4))
        order = np.argsort(label, kind="stable")
        self.label, self.keys = label[order], {"q": g[order], "unit": units[order]}
        self.bits = np.stack([(mask[order] >> s) & 1 for s in seeds], 1).astype(bool)
        self.e = _matrix(batch.column(4))[order]
        self.spans = _spans(self.label)
        self.counts = [self.bits[i:j].sum(0) for _, i, j in self.spans]
        self.most = _longest(self.e)

    @cached_property
    def orders(self) -> dict[str, np.ndarray]:
        return {k: np.argsort(x, kind="stable") for k, x in self.keys.items()}

    def own(self, block: dict, other_unit: bool) -> tuple[np.ndarray, np.ndarray]:
        key = "unit" if other_unit else "q"
        return _forbidden(block[key], self.keys[key], self.orders[key])

    @cached_property
    def number(self) -> np.ndarray:
        return self.bits.astype(np.float64)

    @cached_property
    def merged(self) -> SimpleNamespace:
        """Copies of one vector under one label as one row, which answers under the seeds of all of them; `group` names the row of each (None without copies), `n` counts them by seed."""
        odd = np.arange(self.e.shape[1] + 1, dtype=np.int64) * 0x5851F42D4C957F2D | 1
        key = (self.e.view(np.int64) * odd[1:]).sum(1) + self.label * odd[0]
        key ^= key >> 29
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        if len(first) == len(key) or (self.label[first[group]] != self.label).any() or (self.e[first[group]] != self.e).any():
            return SimpleNamespace(e=self.e, near=self.e.astype(np.float32), bits=self.bits, spans=self.spans, group=None)
        order = np.argsort(first)  # labels stay in order
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first))
        first, group = first[order], place[group]
        n = np.zeros((len(first), self.bits.shape[1]), np.int64)
        np.add.at(n, group, self.bits)
        e = self.e[first]
        return SimpleNamespace(e=e, near=e.astype(np.float32), bits=n > 0, spans=_spans(self.label[first]), group=group, n=n)

    def merged_own(self, own: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Own pairs with merged rows, and the seeds under which other copies answer there."""
        group = self.merged.group
        if group is None:
            return own, np.zeros((len(own[0]), self.bits.shape[1]), bool)
        n = self.merged.n
        pairs, at = np.unique(own[0] * len(n) + group[own[1]], return_inverse=True)
        mine = np.zeros((len(pairs), n.shape[1]), np.int64)
        np.add.at(mine, at, self.bits[own[1]])
        rows, columns = np.divmod(pairs, len(n))
        return (rows, columns), n[columns] > mine


def _products(q: np.ndarray, e: np.ndarray, own: tuple[np.ndarray, np.ndarray], spans: list, step: int) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """Products of some queries at a time with each label's span of a batch (-inf: own ones): first query, end, label, span, products.

    The products are overwritten by those that come next."""
    room = np.empty(min(step, len(q)) * max((j - i for _, i, j in spans), default=0), q.dtype)
    place = np.searchsorted([i for _, i, _ in spans], own[1], "right") - 1
    order = np.lexsort((own[0], place))
    rows, columns = own[0][order], own[1][order]
    cuts = np.searchsorted(place[order], np.arange(len(spans) + 1)).tolist()
    for a in range(0, len(q), step):
        z = min(a + step, len(q))
        for k, (c, i, j) in enumerate(spans):
            part = np.matmul(q[a:z], e[i:j].T, out=room[: (z - a) * (j - i)].reshape(z - a, j - i))
            first, past = (cuts[k] + np.searchsorted(rows[cuts[k] : cuts[k + 1]], [a, z])).tolist()
            part[rows[first:past] - a, columns[first:past] - i] = -np.inf
            yield a, z, c, i, j, part


def _exp(x: np.ndarray, by: float, plus: float, room: np.ndarray) -> np.ndarray:
    """exp(by * x + plus), in room."""
    y = np.multiply(x, by, out=room[: x.size].reshape(x.shape))
    y += plus
    return np.exp(y, out=y)


def _columns(stats: tuple[str, ...], h: float | tuple[float, ...]) -> tuple[dict[str, str], dict[str, float]]:
    """Columns of class scores with their types, and the kernels' widths by column; several widths have a column each (kernel_0 on)."""
    widths = {f"kernel_{k}": x for k, x in enumerate(h)} if isinstance(h, tuple) else {"kernel": h}
    return {c: STATS[s] for s in STATS if s in stats for c in (widths if s == "kernel" else (s,))}, widths if "kernel" in stats else {}


def _class_scores(batches, block, seeds, tau, h, other_unit, stats) -> Iterator[pa.RecordBatch]:
    b = block.value
    stats, widths = _columns(stats, h)
    asked = np.stack([(b["mask"] >> s) & 1 for s in seeds], 1).astype(bool)
    r, k = np.nonzero(asked)  # what is held: a number for each query and seed it is asked under
    held: dict[int, dict[str, np.ndarray]] = {}
    for batch in batches:
        rows = batch if isinstance(batch, _Rows) else _Rows(batch, seeds) if batch.num_rows else None
        if rows is None:
            continue
        e, bits, spans = rows.e, rows.bits, rows.spans
        own = rows.own(b, other_unit)
        slack = _slack(b["e"], rows.most)
        pairs = "soft" in stats or bool(widths) or slack is None  # else sums of vectors and the largest entries do
        number = rows.number if pairs or "total" in stats else None
        step = STEP if len(spans) <= FEW else len(b["q"])
        pieces = spans
        if pairs and "best" not in stats:  # sums: pieces that stay in a core's cache
            pieces = [(c, k, min(k + PIECE, j)) for c, i, j in spans for k in range(i, j, PIECE)]
            step = min(step, PIECE * LEAST // max(j - i for _, i, j in pieces))
        elif pairs:
            pieces = [(c, k, min(k + SPAN, j)) for c, i, j in spans for k in range(i, j, SPAN)]
        room = np.empty(step * max(j - i for _, i, j in pieces) if pairs else 0)
        for (c, i, j), count in zip(spans, rows.counts, strict=True):
            one = held.setdefault(c, {"best": np.full(len(r), -np.inf)} | {name: np.zeros(len(r)) for name in stats if name not in ("best", "n")} | {"n": np.zeros(len(r), np.int64)})
            inside = (own[1] >= i) & (own[1] < j)
            mine = own[0][inside], own[1][inside]
            count = np.broadcast_to(count, asked.shape).copy()
            np.subtract.at(count, mine[0], bits[mine[1]].astype(np.int64))
            one["n"] += count[r, k]
            if "total" in stats and slack is not None:  # by the sum of the vectors, without those that may not answer
                total = b["e"] @ (number[i:j].T @ e[i:j]).T
                np.subtract.at(total, mine[0], np.einsum("ij,ij->i", b["e"][mine[0]], e[mine[1]])[:, None] * number[mine[1]])
                one["total"] += total[r, k]
            elif "total" in stats:
                sims = b["e"] @ e[i:j].T
                sims[mine[0], mine[1] - i] = 0.0
                one["total"] += _summed(sims, number[i:j])[r, k]
        if not pairs and "best" not in stats:
            continue
        if not pairs:
            own, left = rows.merged_own(own)
            e, bits, spans = rows.merged.e, rows.merged.bits, rows.merged.spans
            pieces = [(c, k, min(k + SPAN, j)) for c, i, j in spans for k in range(i, j, SPAN)]
            step = min(step, max(STEP, STEP * SPAN // max(j - i for _, i, j in pieces)))
            some = np.flatnonzero(left.any(1))
            if len(some):  # own rows with copies that may answer
                value = np.einsum("ij,ij->i", b["e"][own[0][some]], e[own[1][some]])
                for c, i, j in spans:
                    mine = (own[1][some] >= i) & (own[1][some] < j)
                    best = np.full(asked.shape, -np.inf)
                    best[r, k] = held[c]["best"]
                    at, s = np.nonzero(left[some[mine]])
                    np.maximum.at(best, (own[0][some[mine]][at], s), value[mine][at])
                    held[c]["best"] = best[r, k]
        for a, z, c, i, j, part in _products(b["e"], e, own, pieces, step) if pairs else _products(b["e"].astype(np.float32), rows.merged.near, own, pieces, step):
            one, some = held[c], slice(*np.searchsorted(r, [a, z]))
            at = r[some] - a, k[some]
            if "soft" in stats:
                one["soft"][some] += _summed(_exp(part, 1 / tau, 0.0, room), number[i:j])[at]
            for name, width in widths.items():
                one[name][some] += _summed(_exp(part, 1 / (width * width), -1 / (width * width), room), number[i:j])[at]
            if "best" in stats:
                best = np.full((z - a, len(seeds)), -np.inf)
                best[at] = one["best"][some]
                if pairs:
                    _raise_best(best, part, asked[a:z], bits[i:j])
                else:
                    _raise_rounded(best, part, slack[a:z], b["e"][a:z], e[i:j], asked[a:z], bits[i:j])
                one["best"][some] = best[at]
    names = ["seed", "q", "label", *stats]
    for c, x in held.items():
        some = np.flatnonzero(x["n"] > 0)
        yield pa.record_batch([pa.array(np.array(seeds, np.int32)[k[some]]), pa.array(b["q"][r[some]]), pa.array(np.full(len(some), c, np.int64)), *(pa.array(x[name][some]) for name in stats)], names=names)


def _nearest(batches, block, seeds, k, other_unit) -> Iterator[pa.RecordBatch]:
    b = block.value
    held = {s: (np.zeros((0, 3)), np.zeros(0)) for s in seeds}
    for batch in batches:
        if not batch.num_rows:
            continue
        g, label, units, mask = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(4))
        sims = b["e"] @ _matrix(batch.column(4)).T
        ok = _allowed(b, g, units, other_unit)
        for s in seeds:
            rows, cols = np.flatnonzero((b["mask"] >> s) & 1), np.flatnonzero((mask >> s) & 1)
            part = np.where(ok[np.ix_(rows, cols)], sims[np.ix_(rows, cols)], -np.inf)
            r, top = knn.best_of(part, g[cols], k)
            ids = np.concatenate([held[s][0], np.stack([b["q"][rows[r]], g[cols[top]], label[cols[top]]], 1)])
            sim = np.concatenate([held[s][1], part[r, top]])
            order = np.lexsort((ids[:, 1], -sim, ids[:, 0]))
            ids, sim = ids[order], sim[order]
            start = np.flatnonzero(np.concatenate([[True], ids[1:, 0] != ids[:-1, 0]])) if len(ids) else np.zeros(0, int)
            place = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
            held[s] = ids[place < k], sim[place < k]
    for s, (ids, sim) in held.items():
        i = ids.astype(np.int64)
        yield pa.record_batch([pa.array(np.full(len(sim), s, np.int32)), pa.array(i[:, 0]), pa.array(i[:, 1]), pa.array(i[:, 2]), pa.array(sim)], names=["seed", "q", "g", "label", "sim"])


def _nearest_one(batches, block, seeds, other_unit) -> Iterator[pa.RecordBatch]:
    """_nearest for one row, by the largest of products in 32 bits."""
    b = block.value
    asked = np.stack([(b["mask"] >> s) & 1 for s in seeds], 1).astype(bool)
    sim, row, klass = np.full(asked.shape, -np.inf), np.zeros(asked.shape, np.int64), np.zeros(asked.shape, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        g, label, units, mask = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(4))
        e, bits = _matrix(batch.column(4)), np.stack([(mask >> s) & 1 for s in seeds], 1).astype(bool)
        own = _forbidden(b["unit"], units) if other_unit else _forbidden(b["q"], g)
        near = _rounded(b["e"], e)
        if near is None:
            sims = b["e"] @ e.T
            sims[own] = -np.inf
            parts = [(0, len(sims), sims, np.full(len(sims), np.inf), 0)]
        else:
            parts = ((a, z, part, near[2][a:z], 64) for a, z, _, _, _, part in _products(near[0], near[1], own, [(0, 0, len(g))], STEP))
        for a, z, part, slack, turns in parts:
            _raise_rounded(sim[a:z], part, slack, b["e"][a:z], e, asked[a:z], bits, (g, label), (row[a:z], klass[a:z]), turns)
    r, k = np.nonzero(asked & (sim > -np.inf))
    yield pa.record_batch([pa.array(np.array(seeds, np.int32)[k]), pa.array(b["q"][r]), pa.array(row[r, k]), pa.array(klass[r, k]), pa.array(sim[r, k])], names=["seed", "q", "g", "label", "sim"])


def _prepared(queries: DataFrame, gallery: DataFrame):
    q = queries.select(F.col("vec_id").cast("long").alias("q"), F.col("unit").cast("long").alias("unit"), F.col("mask").cast("long").alias("mask"), F.col("e").cast("array<double>").alias("e"))
    g = gallery.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("unit").cast("long"), F.col("mask").cast("long"), F.col("e").cast("array<double>"))
    return q, g


def _packed(rows: DataFrame, cell: str, cells: int) -> DataFrame:
    """_s, `cell`, rows: the rows of a cell as one value, in the shared folder by seed. A row is written twice, here and for the grouping."""

    def pack(t: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t.combine_chunks())
        return pa.table([t.column("_s")[:1], t.column(cell)[:1], pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_s", cell, "rows"])

    path, schema = stage_path(rows.sparkSession, "cells"), f"_s int, {cell} int, rows binary"
    rows.repartition(min(SPREAD * cells, 2048), "_s", cell).groupBy("_s", cell).applyInArrow(pack, schema).write.partitionBy("_s").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def _first_of(found: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of each query, ties by g."""
    found = found.sort_by([("q", "ascending"), ("sim", "descending"), ("g", "ascending")])
    q = found.column("q").to_numpy()
    return found.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def _met(batches: Iterator[pa.RecordBatch], fn, names: list[str], schema: pa.Schema, tile: int) -> Iterator[pa.RecordBatch]:
    """fn for cells of queries with one gallery cell after the other; of each query only the nearest rows so far are kept."""
    held: dict[int, pa.Table] = {}
    for batch in batches:
        for seed, cell, queries, gallery in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), batch.column(3), strict=True):
            found = _cell(*(pa.ipc.open_stream(x.as_buffer()).read_all() for x in (queries, gallery)), partial(fn, seeds=(seed,)), names, schema, tile)
            held[cell] = _first_of(pa.concat_tables([held[cell], found]), fn.keywords.get("k", 1)) if cell in held else found
    for found in held.values():
        yield from found.to_batches()


def _over_packed(left: DataFrame, right: DataFrame, fn, names: list[str], arrow: pa.Schema, schema: str, block: int, seeds: list[int], nq: int) -> DataFrame:
    """Each seed's cells of queries with each of its gallery cells, as a Cartesian product: nothing is shuffled, a task holds a few cells of queries and reads gallery cells one by one."""
    spark = left.sparkSession
    runs = -(-TASKS * spark.sparkContext.defaultParallelism // (nq * max(1, len(seeds))))  # of gallery cells, for each cell of queries
    each = [right.where(F.col("_s") == s).select(F.col("rows").alias("gallery")).coalesce(runs).hint("shuffle_replicate_nl").crossJoin(left.where(F.col("_s") == s).select("_s", "_q", F.col("rows").alias("queries"))) for s in seeds]
    if not each:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, each).select("_s", "_q", "queries", "gallery").mapInArrow(partial(_met, fn=fn, names=names, schema=arrow, tile=block), schema)


def _over_blocks(q: DataFrame, g: DataFrame, fn, schema: str, block: int, seeds: tuple[int, ...] = (), ready=None, whole: bool = False) -> DataFrame:
    """fn(batches of g, block) for all of q. A row of either side is copied once for each cell of the other.

    With seeds, rows meet seed by seed (once for each bit of their mask) where that makes fewer pairs than all rows with all. Cells are then packed, a row each, and are read once for each they meet instead of copied;
    fn must be one of the searches for nearest rows."""
    spark, names = g.sparkSession, q.columns
    n = q.limit(block + 1).count()
    if n == 0:
        return spark.createDataFrame([], schema)
    if n <= block:
        return g.mapInArrow(partial(fn, block=spark.sparkContext.broadcast(_block(q.toArrow(), names))), schema)
    cell = max(block, min(TILES * block, knn.BLOCK_BYTES // (8 * q.select(F.size("e").alias("n")).first().n)))
    has = lambda s: F.shiftright("mask", s).bitwiseAND(1)
    sizes = [df.agg(F.count(F.lit(1)).alias("all"), *(F.coalesce(F.sum(has(s)), F.lit(0)).alias(f"s{s}") for s in seeds)).first() for df in (q, g)]
    each = [[x[f"s{s}"] for s in seeds] for x in sizes]
    apart = sum(x * y for x, y in zip(*each, strict=True)) < sizes[0]["all"] * sizes[1]["all"] if seeds else False
    n, m = (max(x) for x in each) if apart else (x["all"] for x in sizes)
    ng = max(1, -(-m // cell))
    nq = max(1, -(-n // cell), min(-(-n // block), -(-TASKS * spark.sparkContext.defaultParallelism // (ng * (len(seeds) if apart else 1)))))  # cells of queries get smaller where there are fewer pairs than work for all cores
    own = lambda df, k: F.pmod(F.xxhash64(df.columns[0]), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    keys = ["_q", "_g"]
    g = g.select(*(F.col(c).alias(c) for c in g.columns))  # both sides may have a column of one and the same table, which cogroup could not tell apart
    left, right = q.withColumn("_q", own(q, nq)), g.withColumn("_g", own(g, ng))
    arrow = pa.schema([pa.field(f.name, ARROW[f.dataType.simpleString()]) for f in StructType.fromDDL(schema)])
    if apart:
        bits = F.explode(F.filter(F.array(*(F.when(has(s) == 1, s) for s in seeds)), lambda x: x.isNotNull()))
        left, right = (df.withColumn("_s", bits).withColumn("mask", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_s"))) for df in (left, right))
        return _over_packed(_packed(left, "_q", nq * len(seeds)), _packed(right, "_g", ng * len(seeds)), fn, names, arrow, schema, block, [s for s, (x, y) in zip(seeds, zip(*each, strict=True), strict=True) if x and y], nq)
    pairs = nq * ng
    parts = max(pairs, min(SPREAD * pairs, 2048))  # a number of its own: some shuffle partitions would get two or three pairs, others none
    left, right = (df.repartition(parts, *keys).groupBy(*keys) for df in (left.select("*", every(ng).alias("_g")), right.select("*", every(nq).alias("_q"))))
    return left.cogroup(right).applyInArrow(lambda a, b: _cell(a, b, fn, names, arrow, block, ready, whole), schema)


def class_scores(queries: DataFrame, gallery: DataFrame, seeds: tuple[int, ...] = (0,), tau: float = 0.1, h: float | tuple[float, ...] = 0.3, other_unit: bool = False, block: int = BLOCK, stats: tuple[str, ...] = tuple(STATS)) -> DataFrame:
    """Per seed, query and gallery label: best similarity, their sum and number, sums of exp(s / tau) and exp((s - 1) / h^2); only those named in stats.

    Both sides: vec_id, unit, mask, e (gallery also label). Bit s of a query's mask: it is asked under seed s; of a
    gallery row's: it may answer. A label without a permitted row is absent. Several h are one pass with columns kernel_0, kernel_1 ... in their order."""
    columns, _ = _columns(stats, h)
    schema = ", ".join(["seed int, q bigint, label bigint", *(f"{c} {kind}" for c, kind in columns.items())])
    fn = partial(_class_scores, seeds=tuple(seeds), tau=tau, h=h, other_unit=other_unit, stats=stats)
    whole = not {"soft", "kernel"} & set(stats)  # a cell's rows of one label are looked through together
    parts = _over_blocks(*_prepared(queries, gallery), fn, schema, block, ready=partial(_Rows, seeds=tuple(seeds)), whole=whole)
    return parts.groupBy("seed", "q", "label").agg(*((F.max if c == "best" else F.sum)(c).alias(c) for c in columns))


def nearest(queries: DataFrame, gallery: DataFrame, k: int, seeds: tuple[int, ...] = (0,), other_unit: bool = False, block: int = BLOCK) -> DataFrame:
    """seed, q, g, label, sim, rank: the k nearest gallery rows, ties by g."""
    if len(seeds) == 1 and not other_unit and not queries.limit(block + 1).count() <= block:
        q, g = (df.where(F.shiftright("mask", seeds[0]).bitwiseAND(1) == 1) for df in _prepared(queries, gallery))
        return knn.join(q.select("q", "e"), g.select(F.col("vec_id").alias("g"), "label", "e"), k).select(F.lit(seeds[0]).alias("seed"), "q", "g", "label", "sim", "rank")
    fn = _nearest_one if k == 1 else partial(_nearest, k=k)
    parts = _over_blocks(*_prepared(queries, gallery), partial(fn, seeds=tuple(seeds), other_unit=other_unit), NEAR, block, tuple(seeds))
    w = W.partitionBy("seed", "q").orderBy(F.desc("sim"), "g")
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _farthest(batches, block) -> Iterator[pa.RecordBatch]:
    b = block.value
    least = np.full(len(b["q"]), np.inf)
    for batch in batches:
        if batch.num_rows:
            least = np.minimum(least, (b["e"] @ _matrix(batch.column(4)).T).min(1))
    some = np.isfinite(least)
    yield pa.record_batch([pa.array(b["q"][some]), pa.array(least[some])], names=["q", "least"])


def farthest(queries: DataFrame, gallery: DataFrame, block: int = BLOCK) -> DataFrame:
    """q, far: the largest distance (1 - similarity) to any gallery row."""
    parts = _over_blocks(*_prepared(queries, gallery), _farthest, "q bigint, least double", block)
    return parts.groupBy("q").agg((1 - F.min("least")).alias("far"))


def scaled_nearest(rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """i, j, d, rank: of all rows the k nearest others by d = (1 - similarity) / far, where far is a column of rows and j's counts.

    d is the negative product of (e, 1) and (e, -1) / far."""
    asked = rows.withColumn("e", F.concat("e", F.array(F.lit(1.0))))
    gallery = rows.withColumn("e", V.scaled(F.concat("e", F.array(F.lit(-1.0))), 1 / (F.col("far") + 1e-12)))
    return nearest(asked, gallery, k, block=block).select(F.col("q").alias("i"), F.col("g").alias("j"), (-F.col("sim")).alias("d"), "rank")


def scaled_pairs(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """i, j, d of given pairs, d as in scaled_nearest."""
    left = rows.select(F.col("vec_id").alias("i"), F.col("e").alias("a"))
    right = rows.select(F.col("vec_id").alias("j"), F.col("e").alias("b"), "far")
    return pairs.join(left, "i").join(right, "j").select("i", "j", ((1 - V.dot(F.col("a"), F.col("b"))) / (F.col("far") + 1e-12)).alias("d"))


# -- readouts: tables (seed, q, label, score)


def exemplar(scores: DataFrame) -> DataFrame:
    return scores.select("seed", "q", "label", F.col("best").alias("score"))


def log_sum_exp(scores: DataFrame, tau: float = 0.1, eps: float = 1e-9) -> DataFrame:
    return scores.select("seed", "q", "label", (tau * F.log(F.col("soft") + eps)).alias("score"))


def kernel_density(scores: DataFrame) -> DataFrame:
    return scores.select("seed", "q", "label", F.col("kernel").alias("score"))


def kernel_posterior(scores: DataFrame) -> DataFrame:
    """Prior times density, normalised: score, and the marginal density of the query."""
    w = W.partitionBy("seed", "q")
    joint = F.col("kernel") * F.col("n")
    rows = scores.withColumn("joint", joint / F.sum("n").over(w)).withColumn("density", F.sum("joint").over(w) + 1e-30)
    return rows.select("seed", "q", "label", (F.col("joint") / F.col("density")).alias("score"), "density")


def knn_vote(near: DataFrame, k: int = 5) -> DataFrame:
    return near.where(F.col("rank") <= k).groupBy("seed", "q", "label").agg(F.sum("sim").alias("score"))


def knn_majority(near: DataFrame, k: int = 5, tie: float = 1e-3) -> DataFrame:
    return near.where(F.col("rank") <= k).groupBy("seed", "q", "label").agg((F.count(F.lit(1)) + tie * F.max("sim")).alias("score"))


def class_means(gallery: DataFrame, dims: int, normal: bool = True, by: tuple[str, ...] = ("label",)) -> DataFrame:
    """Mean vector of each class: one pass, partial sums in the map tasks. `dims` aggregates, no explode."""
    mean = F.array(*[F.avg(F.col("e")[i]) for i in range(dims)])
    rows = gallery.groupBy(*by).agg(mean.alias("mean"), F.count(F.lit(1)).alias("support"))
    return rows.withColumn("mean", V.unit(F.col("mean"))) if normal else rows


def prototype(queries: DataFrame, means: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Cosine to each class mean. Means are one row a class (and seed): a table of the vocabulary's size; queries carry no label."""
    rows = queries.join(means, on) if on else queries.join(means)
    return rows.select(*(on or []), F.col("vec_id").alias("q"), "label", V.dot(F.col("e"), F.col("mean")).alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    """With rank by score; ties go to the smallest label."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("seed", "q").orderBy(F.desc("score"), "label")))


def linear(a: DataFrame, b: DataFrame, weight: float) -> DataFrame:
    """Ensemble: a + weight * b over the same (seed, q, label)."""
    return a.join(b.withColumnRenamed("score", "other"), ["seed", "q", "label"]).select("seed", "q", "label", (F.col("score") + weight * F.col("other")).alias("score"))


# -- instance similarity: needs local scales, the mean of each row's k nearest


def local_scale(near: DataFrame, k: int) -> DataFrame:
    """q, scale: mean similarity of the k nearest."""
    return near.where(F.col("rank") <= k).groupBy("seed", "q").agg(F.avg("sim").alias("scale"))


def with_scales(gallery: DataFrame, scales: DataFrame) -> DataFrame:
    """Gallery rows with their own local scale, ready for csls and local_scaling."""
    return gallery.join(scales.select(F.col("q").alias("vec_id"), "scale"), "vec_id")


def _scaled_best(batches, block, kind) -> Iterator[pa.RecordBatch]:
    b = block.value
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        g, label, scale = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        sims = b["e"] @ _matrix(batch.column(3)).T
        s = 2 * sims - b["scale"][:, None] - scale[None, :] if kind == "csls" else sims / np.sqrt((b["scale"][:, None] + 1e-6) * (scale[None, :] + 1e-6))
        s = np.where(b["q"][:, None] != g[None, :], s, -np.inf)
        for c in np.unique(label).tolist():
            best = s[:, label == c].max(1)
            held[c] = np.maximum(held[c], best) if c in held else best
    for c, best in held.items():
        some = np.isfinite(best)
        yield pa.record_batch([pa.array(np.zeros(int(some.sum()), np.int32)), pa.array(b["q"][some]), pa.array(np.full(int(some.sum()), c, np.int64)), pa.array(best[some])], names=["seed", "q", "label", "score"])


def scaled_exemplar(queries: DataFrame, gallery: DataFrame, kind: str = "csls", block: int = BLOCK) -> DataFrame:
    """Per-class maximum of CSLS (2 s - r_q - r_g) or of local scaling (s / sqrt(r_q r_g)); both sides carry `scale`."""
    q = queries.select(F.col("vec_id").cast("long").alias("q"), F.col("scale"), F.col("e").cast("array<double>").alias("e"))
    g = gallery.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "scale", F.col("e").cast("array<double>"))
    out = _over_blocks(q, g, partial(_scaled_best, kind=kind), "seed int, q bigint, label bigint, score double", block)
    return out.groupBy("seed", "q", "label").agg(F.max("score").alias("score"))


def expanded(queries: DataFrame, gallery: DataFrame, near: DataFrame, dims: int, m: int = 5) -> DataFrame:
    """Average query expansion: unit(query + mean of its m nearest)."""
    top = near.where(F.col("rank") <= m).select(F.col("q"), F.col("g").alias("vec_id")).join(gallery.select("vec_id", "e"), "vec_id")
    mean = top.groupBy("q").agg(F.array(*[F.avg(F.col("e")[i]) for i in range(dims)]).alias("mean"))
    rows = queries.join(mean, queries.vec_id == mean.q)
    return rows.select(*[c for c in queries.columns if c != "e"], V.unit(V.plus(F.col("e"), F.col("mean"))).alias("e"))
