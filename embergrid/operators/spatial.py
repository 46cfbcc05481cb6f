"""Points, patch grids and region maps. Everything is keyed by image, so work spreads over images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embergrid.functions import vectors as V
from embergrid.sources.shared import staged

from . import ranking
from .components import components


def in_frame(x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> Column:
    return (F.col(x) >= 0) & (F.col(y) >= 0) & (F.col(x) < F.col(w)) & (F.col(y) < F.col(h))


def patch_centres(g: int, p: int) -> Column:
    """Array of (r, c, cx, cy), row-major."""
    return F.transform(F.sequence(F.lit(0), F.lit(g * g - 1)), lambda i: F.struct(F.floor(i / g).cast("int").alias("r"), (i % g).cast("int").alias("c"), ((i % g + 0.5) * p).alias("cx"), ((F.floor(i / g) + 0.5) * p).alias("cy")))


def near_pairs(a: DataFrame, b: DataFrame, d: float, on: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Box-distance join |dx| < d and |dy| < d within equal keys: points meet in cells of side d, never all with all."""
    left = a.select("*", F.explode(F.sequence(F.floor(F.col(x) / d) - 1, F.floor(F.col(x) / d) + 1)).alias("_u")).select("*", F.explode(F.sequence(F.floor(F.col(y) / d) - 1, F.floor(F.col(y) / d) + 1)).alias("_v"))
    right = b.select(*[F.col(k) for k in on], *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in on], F.floor(F.col(x) / d).alias("_u"), F.floor(F.col(y) / d).alias("_v"))
    both = left.join(right, [*on, "_u", "_v"])
    return both.where((F.abs(F.col(x) - F.col(f"{x}_b")) < d) & (F.abs(F.col(y) - F.col(f"{y}_b")) < d)).drop("_u", "_v")


def box_overlaps(a: DataFrame, b: DataFrame, pad: int = 0) -> DataFrame:
    """Pairs of boxes (x0, y0, x1, y1) of one image that meet after padding, each pair once."""
    right = b.select("image", *[F.col(c).alias(f"{c}_b") for c in b.columns if c != "image"])
    meet = (F.col("x0") - pad <= F.col("x1_b")) & (F.col("x0_b") - pad <= F.col("x1")) & (F.col("y0") - pad <= F.col("y1_b")) & (F.col("y0_b") - pad <= F.col("y1"))
    return a.join(right, "image").where(meet & (F.col("lab") < F.col("lab_b")))


def gaussian_pool(points: DataFrame, cells: DataFrame, sigmas: list[float], value: str = "v", extra: Column | None = None) -> DataFrame:
    """obs_id, sigma, pooled: softmax(-d^2 / 2 sigma^2 [+ extra]) weighted mean of cell values around a point of the same image."""
    rows = points.join(cells, "image").withColumn("sigma", F.explode(F.array(*[F.lit(float(s)) for s in sigmas])))
    d2 = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
    logit = -d2 / (2 * F.col("sigma") * F.col("sigma"))
    rows = rows.withColumn("_l", logit + extra if extra is not None else logit)
    top = F.max("_l").over(W.partitionBy("obs_id", "sigma"))
    rows = rows.withColumn("_w", F.exp(F.col("_l") - top))
    return rows.groupBy("obs_id", "sigma").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("pooled"))


def bilinear(points: DataFrame, cells: DataFrame, g: int, p: int) -> DataFrame:
    """obs_id, value: bilinear sample of the grid with border clamp."""
    u, v = F.col("x") / p - 0.5, F.col("y") / p - 0.5
    pts = points.select("obs_id", "image", F.floor(u).alias("u0"), F.floor(v).alias("v0"), (u - F.floor(u)).alias("fu"), (v - F.floor(v)).alias("fv"))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    pts = pts.withColumn("k", F.explode(corners))
    clamp = lambda a: F.greatest(F.lit(0), F.least(F.lit(g - 1), a)).cast("int")
    weight = F.when(F.col("k.i") == 1, F.col("fu")).otherwise(1 - F.col("fu")) * F.when(F.col("k.j") == 1, F.col("fv")).otherwise(1 - F.col("fv"))
    pts = pts.select("obs_id", "image", clamp(F.col("u0") + F.col("k.i")).alias("c"), clamp(F.col("v0") + F.col("k.j")).alias("r"), weight.alias("weight"))
    return pts.join(cells, ["image", "r", "c"]).groupBy("obs_id").agg(F.sum(F.col("weight") * F.col("v")).alias("value"))


def coverage_pool(cells: DataFrame, factor: int, flag: Column) -> DataFrame:
    """Share of flagged cells in blocks of factor x factor."""
    return cells.groupBy("image", F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c")).agg(F.avg(flag.cast("double")).alias("coverage"))


def masked_mean(cells: DataFrame, coverage: DataFrame, least: float = 0.5) -> DataFrame:
    """Mean of values where coverage > least; else the value at the largest coverage (first in order)."""
    rows = cells.join(coverage, ["image", "r", "c"])
    good = F.col("coverage") > least
    best = F.min(F.struct((-F.col("coverage")).alias("a"), "r", "c", "v"))
    return rows.groupBy("image").agg(F.coalesce(F.avg(F.when(good, F.col("v"))), best["v"]).alias("value"))


def dark_share(points: DataFrame, cells: DataFrame, radius: int, dark: Column) -> DataFrame:
    """Share of dark cells within a square around each point, by range of cells of the same image."""
    near = points.join(cells, "image").where((F.abs(F.col("r") - F.col("pr")) <= radius) & (F.abs(F.col("c") - F.col("pc")) <= radius))
    return near.groupBy("obs_id").agg(F.avg(dark.cast("double")).alias("share"))


def snap(points: DataFrame, cells: DataFrame, radius: int, fit: Column) -> DataFrame:
    """Nearest fitting cell within the square; points without one are dropped."""
    near = points.join(cells.where(fit), "image").where((F.abs(F.col("r") - F.col("pr")) <= radius) & (F.abs(F.col("c") - F.col("pc")) <= radius))
    d2 = F.pow(F.col("r") - F.col("pr"), 2) + F.pow(F.col("c") - F.col("pc"), 2)
    return near.groupBy("obs_id").agg(F.min(F.struct(d2.alias("d"), "r", "c")).alias("n")).select("obs_id", "n.r", "n.c")


def region_moments(cells: DataFrame, least: int = 16) -> DataFrame:
    """Per region (label > 0 of at least `least` cells): area, centroid, eccentricity from the 2 x 2 covariance, mean value, box."""
    rows = cells.where("lab > 0").groupBy("image", "lab").agg(
        F.count(F.lit(1)).alias("area"), F.avg("c").alias("cx"), F.avg("r").alias("cy"), F.var_pop("c").alias("vxx"), F.var_pop("r").alias("vyy"), F.covar_pop("c", "r").alias("vxy"),
        F.avg("v").alias("depth"), F.min("c").alias("x0"), F.min("r").alias("y0"), F.max("c").alias("x1"), F.max("r").alias("y1"),
    ).where(F.col("area") >= least)
    mid, gap = (F.col("vxx") + F.col("vyy")) / 2, F.sqrt(F.pow((F.col("vxx") - F.col("vyy")) / 2, 2) + F.pow("vxy", F.lit(2)))
    return rows.withColumn("ecc", F.when(mid + gap > 1e-12, F.sqrt(F.greatest(F.lit(0.0), 1 - (mid - gap) / (mid + gap)))).otherwise(0.0)).drop("vxx", "vyy", "vxy")


def hull_area(points: list[tuple[int, int]]) -> float:
    """Area of the convex hull of cells (monotone chain, shoelace); 0 if they lie on a line."""
    points = sorted(set(points))
    def half(ps):
        out: list[tuple[int, int]] = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]
    hull = half(points) + half(points[::-1]) if len(points) > 2 else []
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1], strict=True))) / 2


def solidity(cells: DataFrame) -> DataFrame:
    """area / hull area per region, 1 where the hull is degenerate.

    The hull of a region is that of the first and last cell of each of its rows, which are found by partial aggregation; only these, two a row, come together."""
    import pandas as pd

    ends = cells.where("lab > 0").groupBy("image", "lab", "r").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.countDistinct("c").alias("n"))

    def one(df: pd.DataFrame) -> pd.DataFrame:
        rows = df["r"].tolist()
        hull = hull_area(list(zip(df["c0"].tolist() + df["c1"].tolist(), rows + rows, strict=True)))
        return pd.DataFrame({"image": [int(df["image"].iloc[0])], "lab": [int(df["lab"].iloc[0])], "solidity": [min(1.0, int(df["n"].sum()) / hull) if hull > 0 else 1.0]})

    return ends.groupBy("image", "lab").applyInPandas(one, "image bigint, lab int, solidity double")


def four_neighbours(cells: DataFrame) -> DataFrame:
    """image, a, b: regions with touching sides, both directions."""
    right = cells.select("image", "r", (F.col("c") - 1).alias("c"), F.col("lab").alias("b"))
    below = cells.select("image", (F.col("r") - 1).alias("r"), "c", F.col("lab").alias("b"))
    met = cells.select("image", "r", "c", F.col("lab").alias("a")).join(right.unionByName(below), ["image", "r", "c"]).where("a > 0 and b > 0 and a <> b")
    return met.select("image", "a", "b").unionByName(met.select("image", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def adjacent(cells: DataFrame, reach: int = 2) -> DataFrame:
    """image, a, b (a < b): regions with cells at Chebyshev distance <= reach. Each cell is sent to the cells it reaches."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    sent = cells.where("lab > 0").select("image", F.col("lab").alias("a"), "r", "c", F.explode(steps).alias("s")).select("image", "a", (F.col("r") + F.col("s.i")).alias("r"), (F.col("c") + F.col("s.j")).alias("c")).distinct()
    return sent.join(cells.select("image", "r", "c", F.col("lab").alias("b")), ["image", "r", "c"]).where("b > a").select("image", "a", "b").distinct()


def labelled(cells: DataFrame, tile: int = 256) -> DataFrame:
    """cells (image, r, c, lab) with comp: a number for each connected piece of one label, background too (cells that share a side).

    Pieces are found within tiles of tile x tile cells; those that go on in the next tile are joined along its border by `components`, so no task holds a map. A piece's number is
    the hash of image and first cell of one of its tiles."""
    import numpy as np
    import pandas as pd

    def one(df: pd.DataFrame) -> pd.DataFrame:
        r, c = df["r"].to_numpy(), df["c"].to_numpy()
        at = np.full((int(r.max() - r.min()) + 3, int(c.max() - c.min()) + 3), -1)
        u, v = r - r.min() + 1, c - c.min() + 1
        at[u, v] = np.arange(len(r))
        lab = np.append(df["lab"].to_numpy(), -1)
        low = np.lexsort((c, r)).argsort()  # the order of cells by row and column
        name = np.append(low, len(r))
        near = [n for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)) for n in [at[u + i, v + j]]]
        near = [np.where((n >= 0) & (lab[n] == lab[:-1]), n, np.arange(len(r))) for n in near]
        while True:  # least names spread to neighbours, and by jumps to the cell of that name
            new = np.minimum.reduce([name[:-1], *(name[n] for n in near)])
            new = new[np.argsort(low)[new]]
            if (new == name[:-1]).all():
                break
            name[:-1] = new
        first = np.argsort(low)[name[:-1]]
        return df.assign(r0=r[first], c0=c[first])

    tiles = cells.select("image", "r", "c", "lab", F.floor(F.col("r") / tile).alias("_i"), F.floor(F.col("c") / tile).alias("_j"))
    found = tiles.groupBy("image", "_i", "_j").applyInPandas(one, "image bigint, r int, c int, lab int, _i bigint, _j bigint, r0 int, c0 int")
    found = staged(found.select("image", "r", "c", "lab", F.xxhash64("image", "r0", "c0").alias("piece")), "pieces")
    edges = []
    for line, other in (("r", "c"), ("c", "r")):
        upper = found.where(F.col(line) % tile == tile - 1).select("image", (F.col(line) + 1).alias(line), other, "lab", F.col("piece").alias("a"))
        lower = found.where(F.col(line) % tile == 0).select("image", line, other, "lab", F.col("piece").alias("b"))
        edges.append(upper.join(lower, ["image", line, other, "lab"]).select("a", "b"))
    links = staged(edges[0].unionByName(edges[1]).distinct(), "borders")
    whole = components(links) if not links.isEmpty() else None
    if whole is None:
        return found.withColumnRenamed("piece", "comp")
    return found.join(whole.withColumnRenamed("node", "piece"), "piece", "left").select("image", "r", "c", "lab", F.coalesce("label", "piece").alias("comp"))


def surrounds(cells: DataFrame, least: float = 0.5, tile: int = 256) -> DataFrame:
    """image, a, b: more than `least` of b lies in holes of a. cells: every cell of each map.

    Maps become graphs: connected pieces with their sizes, which of them touch the map's edge, and which share a side. What cannot be reached from the edge without a's pieces lies
    in a hole of a. Only an image's graph, a row for each piece and for two that touch, comes together in one task."""
    import pandas as pd

    pieces = staged(labelled(cells, tile), "labelled")
    edge = pieces.groupBy("image").agg(F.max("r").alias("rn"), F.max("c").alias("cn"))
    outer = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == F.col("rn")) | (F.col("c") == F.col("cn"))
    nodes = pieces.join(edge, "image").groupBy("image", "comp", "lab").agg(F.count(F.lit(1)).alias("n"), F.bool_or(outer).alias("outer"))
    right = pieces.select("image", "r", (F.col("c") - 1).alias("c"), F.col("comp").alias("b"))
    below = pieces.select("image", (F.col("r") - 1).alias("r"), "c", F.col("comp").alias("b"))
    touch = pieces.select("image", "r", "c", F.col("comp").alias("a")).join(right.unionByName(below), ["image", "r", "c"]).where("a <> b").select("image", "a", "b").distinct()

    def one(key, own: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        lab, size = dict(zip(own["comp"], own["lab"], strict=True)), dict(zip(own["comp"], own["n"], strict=True))
        beside: dict[int, list[int]] = {}
        for a, b in zip(met["a"], met["b"], strict=True):
            beside.setdefault(a, []).append(b)
            beside.setdefault(b, []).append(a)
        total = own.groupby("lab")["n"].sum()
        rim, out = own.loc[own["outer"], "comp"].tolist(), []
        for a in sorted(x for x in total.index if x > 0):
            seen = {p for p in rim if lab[p] != a}
            todo = list(seen)
            while todo:
                for q in beside.get(todo.pop(), ()):
                    if q not in seen and lab[q] != a:
                        seen.add(q)
                        todo.append(q)
            inside: dict[int, int] = {}
            for p, x in lab.items():
                if x > 0 and x != a and p not in seen:
                    inside[x] = inside.get(x, 0) + size[p]
            out += [(key[0], a, b) for b, n in sorted(inside.items()) if n > least * total[b]]
        return pd.DataFrame(out, columns=["image", "a", "b"])

    nodes, touch = staged(nodes, "nodes"), staged(touch, "touching")
    return nodes.groupBy("image").cogroup(touch.groupBy("image")).applyInPandas(one, "image bigint, a int, b int")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs of `surrounds` as typed edges, each with its inverse."""
    edge = lambda a, b, kind: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(kind).alias("edge"))
    return pairs.select("image", F.inline(F.array(edge("a", "b", "surrounds"), edge("b", "a", "inside"))))


def typed_edges(regions: DataFrame, pairs: DataFrame, width: float, height: float | None = None) -> DataFrame:
    """Directed edges of neighbouring regions: 'adjacent' both ways, 'medial'/'lateral' by distance to the vertical axis, 'deep'
    from the deeper one. Where a depth is null and height is given, the one nearer to the centre is deeper. A tie gives no edge."""
    side = lambda k: regions.select("image", F.col("lab").alias(k), *(F.col(c).alias(k + c) for c in ("cx", "cy", "depth")))
    rows = pairs.join(side("a"), ["image", "a"]).join(side("b"), ["image", "b"])
    off = lambda k: F.abs(F.col(k + "cx") - width / 2)
    lead = F.col("adepth") - F.col("bdepth")
    if height is not None:
        away = lambda k: F.sqrt(F.pow(F.col(k + "cx") - width / 2, F.lit(2)) + F.pow(F.col(k + "cy") - height / 2, F.lit(2)))
        lead = F.coalesce(lead, away("b") - away("a"))
    inner, lead = F.signum(off("b") - off("a")), F.signum(lead)
    edge = lambda i, j, rel, holds: F.when(holds, F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(rel).alias("rel")))
    always = F.lit(True)
    found = [edge("a", "b", "adjacent", always), edge("b", "a", "adjacent", always), edge("a", "b", "medial", inner > 0), edge("b", "a", "lateral", inner > 0), edge("b", "a", "medial", inner < 0), edge("a", "b", "lateral", inner < 0), edge("a", "b", "deep", lead > 0), edge("b", "a", "deep", lead < 0)]
    return rows.select("image", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def upsampled(coarse: DataFrame, n: int, size: int) -> DataFrame:
    """image, r, c, lab: an n x n label map (br, bc) at size x size by nearest cell; fine cell r reads coarse cell r * n / size."""
    span = lambda at: F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda x: F.floor(x * n / size) == F.col(at))
    rows = coarse.select("image", "lab", "bc", F.explode(span("br")).alias("r"))
    return rows.select("image", "r", F.explode(span("bc")).alias("c"), "lab")


MAP_CELLS = 250_000


def clustered(cells: DataFrame, k: int = 12, beta: float = 2.0, rounds: int = 10, map_cells: int = MAP_CELLS) -> DataFrame:
    """image, r, c, lab (from 1): k-means of each image's cells over [unit token; beta * position / side of the map].

    cells: image, r, c, token (array). Starts: k cells evenly spaced in row-major order; a cluster that loses all cells keeps its
    centre; ties go to the smaller number. Maps of up to `map_cells` cells are one group each; larger ones are dealt out, a round being one aggregation."""
    large = cells.groupBy("image").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > map_cells).select("image")
    if large.isEmpty():
        return _clustered_whole(cells, k, beta, rounds)
    large = staged(large, "large_maps")
    small = _clustered_whole(cells.join(large, "image", "left_anti"), k, beta, rounds)
    return small.unionByName(_clustered_dealt(cells.join(large, "image", "left_semi"), k, beta, rounds))


def _clustered_dealt(cells: DataFrame, k: int, beta: float, rounds: int) -> DataFrame:
    side = cells.groupBy("image").agg((F.greatest(F.max("r"), F.max("c")) + 1).alias("_side"))
    place = F.array(beta * F.col("r") / F.col("_side"), beta * F.col("c") / F.col("_side"))
    rows = cells.join(side, "image").select("image", "r", "c", F.concat(V.unit_clamped(F.col("token").cast("array<double>")), place).alias("f"))
    rows = staged(ranking.ranged(rows, ["image"], [F.col("r"), F.col("c")]), "cells")
    dims = rows.select(F.size("f").alias("d")).first().d
    most = F.least(F.lit(k), F.col("n"))
    starts = F.filter(F.sequence(F.lit(0), most - 1), lambda j: F.floor(j * F.col("n") / most) == F.col("rank") - 1)
    first = rows.select("image", "f", F.explode(starts).alias("j"))
    centres = staged(first.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "f"))), lambda x: x["f"]).alias("g")), "centres")  # k rows an image
    for step in range(rounds):
        gaps = F.transform("g", lambda g: V.squared_distance(F.col("f"), g))
        own = rows.join(centres, "image").withColumn("_d", gaps).select("image", "r", "c", "f", F.array_position("_d", F.array_min("_d")).cast("int").alias("lab"))
        if step == rounds - 1:
            return own.select("image", "r", "c", "lab")
        means = own.groupBy("image", "lab").agg(F.array(*[F.avg(F.col("f")[i]) for i in range(dims)]).alias("m"))
        old = centres.select("image", F.posexplode("g").alias("j", "g")).withColumn("lab", F.col("j") + 1)
        moved = old.join(means, ["image", "lab"], "left").groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("lab", F.coalesce("m", "g").alias("g")))), lambda x: x["g"]).alias("g"))
        centres = staged(moved, "centres")
    return rows.select("image", "r", "c", F.lit(0).alias("lab"))


def _clustered_whole(cells: DataFrame, k: int, beta: float, rounds: int) -> DataFrame:
    import numpy as np
    import pandas as pd

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["r", "c"])
        token = np.stack(df["token"].to_numpy()).astype(float)
        place = df[["r", "c"]].to_numpy(float)
        feats = np.hstack([token / np.maximum(np.linalg.norm(token, axis=1, keepdims=True), 1e-12), beta * place / (place.max() + 1)])
        n = min(k, len(feats))
        centres = feats[np.arange(n) * len(feats) // n]
        lab = np.zeros(len(feats), int)
        for _ in range(rounds):
            lab = ((feats[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.stack([feats[lab == j].mean(0) if (lab == j).any() else centres[j] for j in range(n)])
        return pd.DataFrame({"image": df["image"], "r": df["r"], "c": df["c"], "lab": (lab + 1).astype("int32")})

    return cells.select("image", "r", "c", "token").groupBy("image").applyInPandas(one, "image bigint, r int, c int, lab int")


def relational_mean(edges: DataFrame, nodes: DataFrame, value: str = "h") -> DataFrame:
    """Row-normalised typed adjacency times node values: mean over the neighbours by relation."""
    n = nodes.select("image", F.col("lab").alias("j"), F.col(value).alias("_h"))
    return edges.join(n, ["image", "j"]).groupBy("image", "i", "rel").agg((F.sum("_h") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean"), F.count(F.lit(1)).alias("degree"))


def saliency(cells: DataFrame, pooled: DataFrame) -> DataFrame:
    """Product of cell and pooled value, min-max scaled over each image."""
    w = W.partitionBy("image")
    rows = cells.join(pooled, "image").withColumn("s", F.col("v") * F.col("pooled"))
    low, high = F.min("s").over(w), F.max("s").over(w)
    return rows.select("image", "r", "c", F.when(high > low, (F.col("s") - low) / (high - low)).otherwise(0.0).alias("saliency"))
