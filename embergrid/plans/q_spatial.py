"""Points, patch grids, regions and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from embergrid.functions import vectors as V
from embergrid.operators import spatial as G

from . import fixtures as X
from .registry import query

CELLS = X.GRID + ", cell as (select *, (c + 0.5) * 80 as cx, (r + 0.5) * 60 as cy from grid)"


def _cells(spark, sf_dir):
    return X.grid(spark, sf_dir).withColumn("cx", (F.col("c") + 0.5) * 80).withColumn("cy", (F.col("r") + 0.5) * 60)


def _points(spark, sf_dir):
    """One point an image: the pin whose obs_id is the image's vec_id."""
    return X.pins(spark, sf_dir).select("obs_id", F.col("obs_id").alias("image"), "x", "y", F.floor(F.greatest(F.least("x", F.lit(639)), F.lit(0)) / 80).cast("int").alias("pc"), F.floor(F.greatest(F.least("y", F.lit(479)), F.lit(0)) / 60).cast("int").alias("pr"))


POINTS = X.PINS + ", pt as (select obs_id, obs_id as image, x, y, (greatest(least(x, 639), 0) // 80)::int as pc, (greatest(least(y, 479), 0) // 60)::int as pr from pins)"


@query(f"with {X.PINS} select obs_id from pins where x >= 0 and y >= 0 and x < w and y < h")
def q_in_frame(spark, sf_dir):
    return X.pins(spark, sf_dir).where(G.in_frame()).select("obs_id")


@query(f"with {X.PINS} select source, count(*) as n, sum((not (x >= 0 and y >= 0 and x < w and y < h))::int)::bigint as dropped from (select *, src as source from pins) group by source")
def q_out_of_frame_counter(spark, sf_dir):
    return X.pins(spark, sf_dir).groupBy(F.col("src").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~G.in_frame()).alias("dropped"))


@query(f"with {X.PINS} select floor(x / 640.0 * 30)::bigint as bx, floor(y / 480.0 * 30)::bigint as by, count(*) as n from pins where x >= 0 and y >= 0 and x < w and y < h group by all")
def q_spatial_hist(spark, sf_dir):
    rows = X.pins(spark, sf_dir).where(G.in_frame())
    return rows.groupBy(F.floor(F.col("x") / 640.0 * 30).alias("bx"), F.floor(F.col("y") / 480.0 * 30).alias("by")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {X.PINS} select a.obs_id as a, b.obs_id as b from pins a join pins b on a.page = b.page and a.obs_id < b.obs_id and abs(a.x - b.x) < 120 and abs(a.y - b.y) < 120")
def q_near_points(spark, sf_dir):
    p = X.pins(spark, sf_dir).select("page", "obs_id", "x", "y")
    return G.near_pairs(p, p, 120, ["page"]).where("obs_id < obs_id_b").select(F.col("obs_id").alias("a"), F.col("obs_id_b").alias("b"))


@query(f"with {X.PINS}, {CELLS}, s as (select unnest([40.0, 90.0])::double as sigma), l as (select obs_id, sigma, v, -(pow(x - cx, 2) + pow(y - cy, 2)) / (2 * sigma * sigma) as l from pins join cell on cell.image = pins.obs_id, s), w as (select *, exp(l - max(l) over (partition by obs_id, sigma)) as w from l) select obs_id, sigma, round(sum(w * v) / sum(w), 6) as pooled from w group by all")
def q_gauss_pool(spark, sf_dir):
    rows = G.gaussian_pool(_points(spark, sf_dir).drop("pc", "pr"), _cells(spark, sf_dir), [40.0, 90.0])
    return rows.select("obs_id", "sigma", F.round("pooled", 6).alias("pooled"))


@query(f"with {X.PINS}, {CELLS}, seed as (select image, v as sv from cell where r = 4 and c = 4), l as (select obs_id, v, -(pow(x - cx, 2) + pow(y - cy, 2)) / (2 * 90.0 * 90.0) + v * sv / 0.1 as l from pins join cell on cell.image = pins.obs_id join seed on seed.image = pins.obs_id), w as (select *, exp(l - max(l) over (partition by obs_id)) as w from l) select obs_id, round(sum(w * v) / sum(w), 6) as pooled from w group by obs_id")
def q_coherent_pool(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    seed = cells.where("r = 4 and c = 4").select("image", F.col("v").alias("sv"))
    rows = G.gaussian_pool(_points(spark, sf_dir).drop("pc", "pr"), cells.join(seed, "image"), [90.0], extra=F.col("v") * F.col("sv") / 0.1)
    return rows.select("obs_id", F.round("pooled", 6).alias("pooled"))


@query(f"""with {X.PINS}, {CELLS}, p as (select obs_id, floor(x / 80.0 - 0.5)::int as u, floor(y / 60.0 - 0.5)::int as t, x / 80.0 - 0.5 as a, y / 60.0 - 0.5 as b from pins), k as (select * from range(2) i(i), range(2) j(j)),
w as (select obs_id, greatest(0, least(7, u + i)) as c, greatest(0, least(7, t + j)) as r, (case when i = 1 then a - u else 1 - (a - u) end) * (case when j = 1 then b - t else 1 - (b - t) end) as w from p, k)
select obs_id, round(sum(w * v), 6) as value from w join cell on cell.image = obs_id and cell.r = w.r and cell.c = w.c group by obs_id""")
def q_bilinear(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("y", F.col("y") * (80.0 / 60.0))
    return G.bilinear(p, X.grid(spark, sf_dir), 8, 80).select("obs_id", F.round("value", 6).alias("value"))


@query(f"with {CELLS} select image, (r // 2)::int as r, (c // 2)::int as c, round(avg((v > 0)::int), 6) as coverage from cell group by image, 2, 3")
def q_coverage_pool(spark, sf_dir):
    rows = G.coverage_pool(X.grid(spark, sf_dir), 2, F.col("v") > 0)
    return rows.select("image", "r", "c", F.round("coverage", 6).alias("coverage"))


@query(f"with {CELLS}, m as (select image, r, c, v, abs(v) * 3 as cov from cell) select image, round(coalesce(avg(case when cov > 0.5 then v end), arg_min(v, (-cov, r, c))), 6) as value from m group by image")
def q_masked_mean(spark, sf_dir):
    g = X.grid(spark, sf_dir)
    rows = G.masked_mean(g, g.select("image", "r", "c", (F.abs("v") * 3).alias("coverage")))
    return rows.select("image", F.round("value", 6).alias("value"))


@query(f"with {POINTS}, {CELLS} select obs_id, round(avg((v < 0)::int), 6) as share from pt join cell using (image) where abs(r - pr) <= 1 and abs(c - pc) <= 1 group by obs_id having avg((v < 0)::int) >= 0.55")
def q_dark_neighbourhood(spark, sf_dir):
    rows = G.dark_share(_points(spark, sf_dir), X.grid(spark, sf_dir), 1, F.col("v") < 0)
    return rows.where("share >= 0.55").select("obs_id", F.round("share", 6).alias("share"))


@query(f"with {POINTS}, {CELLS}, n as (select obs_id, r, c, row_number() over (partition by obs_id order by pow(r - pr, 2) + pow(c - pc, 2), r, c) as k from pt join cell using (image) where abs(r - pr) <= 2 and abs(c - pc) <= 2 and v > 0.15) select obs_id, r, c from n where k = 1")
def q_snap_points(spark, sf_dir):
    return G.snap(_points(spark, sf_dir), X.grid(spark, sf_dir), 2, F.col("v") > 0.15)


MOMENTS = f"""{X.REGIONS}, m as (select image, lab, count(*) as area, avg(c) as cx, avg(r) as cy, var_pop(c) as vxx, var_pop(r) as vyy, covar_pop(c, r) as vxy, avg(v) as depth, min(c) as x0, min(r) as y0, max(c) as x1, max(r) as y1 from cells where lab > 0 group by image, lab having count(*) >= 4),
e as (select *, (vxx + vyy) / 2 as mid, sqrt(pow((vxx - vyy) / 2, 2) + vxy * vxy) as gap from m)"""


@query(f"with {MOMENTS} select image, lab, area, round(cx, 6) as cx, round(cy, 6) as cy, round(case when mid + gap > 1e-12 then sqrt(greatest(0.0, 1 - (mid - gap) / (mid + gap))) else 0 end, 5) as ecc, round(depth, 6) as depth, x0, y0, x1, y1 from e")
def q_region_moments(spark, sf_dir):
    rows = G.region_moments(X.regions(spark, sf_dir), 4)
    return rows.select("image", "lab", "area", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), F.round("ecc", 5).alias("ecc"), F.round("depth", 6).alias("depth"), "x0", "y0", "x1", "y1")


@query(f"with {MOMENTS} select a.image, a.lab as a, b.lab as b from m a join m b on a.image = b.image and a.lab < b.lab and a.x0 - 1 <= b.x1 and b.x0 - 1 <= a.x1 and a.y0 - 1 <= b.y1 and b.y0 - 1 <= a.y1")
def q_box_overlaps(spark, sf_dir):
    boxes = G.region_moments(X.regions(spark, sf_dir), 4).select("image", "lab", "x0", "y0", "x1", "y1")
    return G.box_overlaps(boxes, boxes, 1).select("image", F.col("lab").alias("a"), F.col("lab_b").alias("b"))


@query(f"with {X.REGIONS}, n as (select a.image, a.lab as a, b.lab as b from cells a join cells b on a.image = b.image and ((b.r = a.r and b.c = a.c + 1) or (b.r = a.r + 1 and b.c = a.c)) where a.lab > 0 and b.lab > 0 and a.lab <> b.lab) select distinct image, a, b from (select image, a, b from n union all select image, b, a from n)")
def q_region_adjacency(spark, sf_dir):
    return G.four_neighbours(X.regions(spark, sf_dir))


PAIRS = f"{MOMENTS}, ad as (select distinct a.image, a.lab as a, b.lab as b from cells a join cells b on a.image = b.image and abs(a.r - b.r) <= 2 and abs(a.c - b.c) <= 2 and 0 < a.lab and a.lab < b.lab)"
EDGES = f"""{PAIRS}, t as (select ad.image, a, b, sign(abs(y.cx - 4) - abs(x.cx - 4)) as near, sign(x.depth - y.depth) as deep from ad join m x on x.image = ad.image and x.lab = a join m y on y.image = ad.image and y.lab = b),
bo as (select * from t union all select image, b, a, -near, -deep from t), ed as (select image, a as i, b as j, unnest(list_filter(['adjacent', case when near > 0 then 'medial' when near < 0 then 'lateral' end, case when deep > 0 then 'deep' end], lambda x: x is not null)) as rel from bo)"""


def _edges(spark, sf_dir):
    cells = X.regions(spark, sf_dir)
    regions = G.region_moments(cells, 4)
    return G.typed_edges(regions, G.adjacent(cells), 8.0), regions


@query(f"with {PAIRS} select * from ad")
def q_region_near(spark, sf_dir):
    return G.adjacent(X.regions(spark, sf_dir))


@query(f"with {EDGES} select * from ed")
def q_typed_edges(spark, sf_dir):
    return _edges(spark, sf_dir)[0]


@query(f"with {EDGES} select image, i, rel, round(sum(area) / greatest(count(*), 1), 6) as mean, count(*) as degree from ed join m on m.image = ed.image and m.lab = ed.j group by all".replace("select image, i", "select ed.image, i"))
def q_rel_mean_agg(spark, sf_dir):
    edges, regions = _edges(spark, sf_dir)
    return G.relational_mean(edges, regions.withColumn("h", F.col("area").cast("double"))).select("image", "i", "rel", F.round("mean", 6).alias("mean"), "degree")


@query(f"with {EDGES} select image, i, rel, list_sort(list(distinct j)) as neighbours from ed group by all")
def q_neighbours_by_relation(spark, sf_dir):
    return _edges(spark, sf_dir)[0].groupBy("image", "i", "rel").agg(F.array_sort(F.collect_set("j")).alias("neighbours"))


#: Hull edges: every cell lies to one side of them, or between their ends. The shoelace sum over them is twice the hull's area.
HULL = """pt as (select image, lab, r, c from cells where lab > 0), he as (select p.image, p.lab, any_value(p.c * q.r - q.c * p.r) as x from pt p join pt q on p.image = q.image and p.lab = q.lab and (p.r <> q.r or p.c <> q.c) join pt o on o.image = p.image and o.lab = p.lab group by p.image, p.lab, p.r, p.c, q.r, q.c
having bool_and(case when (q.c - p.c) * (o.r - p.r) - (q.r - p.r) * (o.c - p.c) = 0 then (q.c - p.c) * (o.c - p.c) + (q.r - p.r) * (o.r - p.r) between 0 and (q.c - p.c) * (q.c - p.c) + (q.r - p.r) * (q.r - p.r) else (q.c - p.c) * (o.r - p.r) - (q.r - p.r) * (o.c - p.c) > 0 end)),
hu as (select image, lab, abs(sum(x)) / 2.0::double as hull from he group by image, lab), so as (select image, lab, case when coalesce(any_value(hull), 0) > 0 then least(1.0::double, count(*) / any_value(hull)) else 1.0::double end as solidity from pt left join hu using (image, lab) group by image, lab)"""


@query(f"with {MOMENTS}, {HULL} select image, lab, round(depth, 6) as value, round(sqrt(area) / 8.0, 6) as size, round(cx / 8, 6) as x, round(cy / 8, 6) as y, round(case when mid + gap > 1e-12 then sqrt(greatest(0.0, 1 - (mid - gap) / (mid + gap))) else 0 end, 5) as ecc, round(solidity, 6) as solidity from e join so using (image, lab)")
def q_node_features(spark, sf_dir):
    """A region's mean value, root of its area by the map's diagonal measure, centre, eccentricity and solidity."""
    cells = X.regions(spark, sf_dir)
    rows = G.region_moments(cells, 4).join(G.solidity(cells), ["image", "lab"])
    shape = {"value": F.col("depth"), "size": F.sqrt("area") / 8.0, "x": F.col("cx") / 8, "y": F.col("cy") / 8, "solidity": F.col("solidity")}
    return rows.select("image", "lab", *(F.round(v, 6).alias(k) for k, v in shape.items()), F.round("ecc", 5).alias("ecc"))


@query(f"with {CELLS}, p as (select image, avg(v) as pooled from cell group by image), s as (select image, r, c, v * pooled as s from cell join p using (image)), m as (select *, min(s) over (partition by image) as lo, max(s) over (partition by image) as hi from s) select image, r, c, round(case when hi > lo then (s - lo) / (hi - lo) else 0 end, 5) as saliency from m")
def q_saliency(spark, sf_dir):
    cells = X.grid(spark, sf_dir)
    return G.saliency(cells, cells.groupBy("image").agg(F.avg("v").alias("pooled"))).select("image", "r", "c", F.round("saliency", 5).alias("saliency"))


@query(f"with {X.REGIONS}, k as (select image, (r // 4)::int as br, (c // 4)::int as bc, lab, count(*) as n from cells group by all) select image, br, bc, arg_min(lab, (-n, lab)) as lab from k group by image, br, bc")
def q_label_map(spark, sf_dir):
    rows = X.regions(spark, sf_dir).groupBy("image", F.expr("int(r div 4)").alias("br"), F.expr("int(c div 4)").alias("bc"), "lab").count()
    return rows.groupBy("image", "br", "bc").agg(F.min(F.struct((-F.col("count")).alias("n"), "lab")).alias("m")).select("image", "br", "bc", "m.lab")


@query(f"with {X.REGIONS}, {HULL} select image, lab, round(solidity, 6) as solidity from so")
def q_solidity(spark, sf_dir):
    return G.solidity(X.regions(spark, sf_dir)).select("image", "lab", F.round("solidity", 6).alias("solidity"))


@query(f"""with {X.GRID}, x as (select image, bool_or(r = 1 and c = 3 and v > 0) as gap, count_if(v > 0 and r between 2 and 4 and c between 2 and 4) as inside, count_if(v > 0 and r = 7) as outside from grid group by image),
k as (select image from x where not gap and inside > 0.5 * (inside + outside)) select image, 1 as a, 2 as b, 'surrounds' as edge from k union all select image, 2, 1, 'inside' from k""")
def q_surrounds(spark, sf_dir):
    """A ring with a gap in some images, and a region inside and below it: edges in both directions."""
    r, c, v = F.col("r"), F.col("c"), F.col("v")
    hole = r.between(2, 4) & c.between(2, 4)
    ring = r.between(1, 5) & c.between(1, 5) & ~hole & ~((r == 1) & (c == 3) & (v > 0))
    lab = F.when(ring, 1).when((v > 0) & (hole | (r == 7)), 2).otherwise(0).cast("int")
    return G.both_ways(G.surrounds(X.grid(spark, sf_dir).withColumn("lab", lab)))


@query(f"with {X.PINS} select obs_id, least(w - 1.0, greatest(0.0, 0.9 * x - 0.1 * y + 5)) as ax, least(h - 1.0, greatest(0.0, 0.1 * x + 0.9 * y - 3)) as ay, round_even(x * (320.0::double / w), 0)::int as half_x from pins".replace("as ax", "as ax").replace("0.9 * x - 0.1 * y + 5", "0.9::double * x - 0.1::double * y + 5").replace("0.1 * x + 0.9 * y - 3", "0.1::double * x + 0.9::double * y - 3"))
def q_point_transforms(spark, sf_dir):
    p = X.pins(spark, sf_dir)
    moved = V.affine(F.col("x"), F.col("y"), (0.9, -0.1, 5.0, 0.1, 0.9, -3.0), F.col("w"), F.col("h"))
    return p.select("obs_id", moved.alias("m"), V.rescale(F.col("x"), F.col("w"), F.lit(320.0)).alias("half_x")).select("obs_id", F.col("m.x").alias("ax"), F.col("m.y").alias("ay"), "half_x")
