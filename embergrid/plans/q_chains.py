"""Operators chained as reports use them: splits that are sealed, flags instead of drops, intervals, prompts, maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from embergrid.functions import text as T
from embergrid.functions import vectors as V
from embergrid.operators import retrieval as R
from embergrid.operators import spatial as G
from embergrid.operators import splits as S
from embergrid.sources import records as IO
from embergrid.sources.shared import stage_path

from . import fixtures as X
from .q_retrieval import _search, q_learning_curve, scored
from .q_spatial import PAIRS
from .q_text import NAMES, labels
from .registry import ORACLES, query


@query(f"with {X.PINS} select obs_id, x, y, x >= 0 and y >= 0 and x < w and y < h as in_frame, count_if(not (x >= 0 and y >= 0 and x < w and y < h)) over (partition by image) as flagged from pins")
def q_in_frame_flags(spark, sf_dir):
    """Points outside the frame are marked, not dropped, with the number of marks on the image."""
    rows = X.pins(spark, sf_dir).withColumn("in_frame", G.in_frame())
    marks = rows.groupBy("image").agg(F.count_if(~F.col("in_frame")).alias("flagged"))
    return rows.join(marks, "image").select("obs_id", "x", "y", "in_frame", "flagged")


@query(f"with {X.REGIONS}, k as (select image, (r // 4)::int as br, (c // 4)::int as bc, lab, count(*) as n from cells group by all), b as (select image, br, bc, arg_min(lab, (-n, lab)) as lab from k group by image, br, bc) select image, u.r::int as r, t.c::int as c, lab from b, range(8) u(r), range(8) t(c) where br = u.r * 2 // 8 and bc = t.c * 2 // 8")
def q_upsampled_map(spark, sf_dir):
    """The coarse label map at full size: each fine cell has the label of the coarse cell it lies in."""
    counts = X.regions(spark, sf_dir).groupBy("image", F.expr("int(r div 4)").alias("br"), F.expr("int(c div 4)").alias("bc"), "lab").count()
    coarse = counts.groupBy("image", "br", "bc").agg(F.min(F.struct((-F.col("count")).alias("n"), "lab")).alias("m")).select("image", "br", "bc", F.col("m.lab").alias("lab"))
    return G.upsampled(coarse, 2, 8)


@query(f"""with {X.SIGNAL}, cs as (select label, i, avg(e[i + 1]) as m from v, range(64) d(i) where label < 9 group by label, i), cm as (select label, list(m order by i) as m from cs group by label), vo as (select distinct label from v)
select q.vec_id as q, vo.label, m is not null as filled, round(-list_sum(list_transform(range(64), lambda i: pow(q.e[i + 1] - m[i + 1], 2))) / 0.5::double, 6) as logit from v q cross join vo left join cm on cm.label = vo.label where q.vec_id % 50 = 0""")
def q_prototype_logits(spark, sf_dir):
    """-d^2 / tau to class means that are not made unit; a class without gallery rows is not filled and has no logit."""
    asked, gallery = _search(spark, sf_dir)
    vocabulary = gallery.select("label").distinct()
    means = R.class_means(gallery.where("label < 9"), X.DIMS, normal=False).select("label", "mean")
    table = F.broadcast(vocabulary.join(means, "label", "left"))  # one row a class
    rows = asked.select(F.col("vec_id").alias("q"), "e").join(table)
    logit = -V.squared_distance(F.col("e"), F.col("mean")) / 0.5
    return rows.select("q", "label", F.col("mean").isNotNull().alias("filled"), F.round(logit, 6).alias("logit"))


def _line(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"""with {NAMES}, g as (select obs_id // 8 as k, list_sort(list(distinct label)) as names from n group by 1), s as (select k, names, 'It lies on: pin ' || k::varchar || '.' || chr(10) || 'It is next to ' || array_to_string(names, ', ') || '.' as text from g)
select k, array_to_string([{", ".join(_line(x) for x in T.PROMPT_HEAD)}, text, '', 'Choose one of:', array_to_string(list_transform(names, lambda x, i: i::varchar || '. ' || x), chr(10)), {", ".join(_line(x) for x in T.PROMPT_TAIL)}], chr(10)) as prompt from s""")
def q_prompts(spark, sf_dir):
    """Prompts from the surroundings with a numbered list of candidates."""
    rows = labels(spark, sf_dir).groupBy(F.expr("obs_id div 8").alias("k")).agg(F.array_sort(F.collect_set("label")).alias("names"))
    relation = F.array(F.struct(F.lit(1).alias("rel"), F.lit("next to").alias("phrase"), F.col("names")))
    around = T.sentences(F.concat(F.lit("pin "), F.col("k").cast("string")), relation)
    return rows.select("k", T.prompt(around, F.col("names")).alias("prompt"))


KEPT = f"{X.RAW}, w as (select * from v where label < 5)"


@query(f"with {KEPT}, {X.split_sql(2, source='w')} select seed, unit, is_test from split")
def q_restricted_split(spark, sf_dir):
    """The split of the units that some rows belong to, and of no others."""
    rows = X.raw_vectors(spark, sf_dir)
    kept = rows.where("label < 5").select("vec_id")
    return S.grouped_split(rows.join(kept, "vec_id", "left_semi"), "unit", 0.3, [0, 1])


@query(f"with {X.RAW}, {X.split_sql(1)} select unit, case when is_test then 'test' else 'dev' end as side from split")
def q_sealed_split(spark, sf_dir):
    """Development and test units, drawn once: a later draw with another seed reads the sealed one back."""
    rows, path = X.raw_vectors(spark, sf_dir), stage_path(spark, "sealed")
    draw = lambda seed: S.grouped_split(rows, "unit", 0.3, [seed]).select("unit", F.when(F.col("is_test"), "test").otherwise("dev").alias("side"))
    IO.write_once(draw(0), path)
    return IO.write_once(draw(1), path)


@query(f"with lc as ({ORACLES['q_learning_curve']}), g as (select max(case when fraction = 1 then top1 end) as most, max(case when fraction = 0.75 then top1 end) as before from lc) select round(most - before, 1) as slope, round(most - before, 1) >= 1 as rising from g")
def q_gallery_slope(spark, sf_dir):
    """What the last quarter of the gallery adds to the accuracy, and whether that is a percent or more."""
    at = lambda f: F.max(F.when(F.col("fraction") == f, F.col("top1")))
    slope = q_learning_curve(spark, sf_dir).agg(F.round(at(1.0) - at(0.75), 1).alias("slope"))
    return slope.withColumn("rising", F.col("slope") >= 1)


@query(f"""with {X.SIGNAL}, {X.scores_sql(1)}, b as (select q, truth, arg_min(label, (-best, label)) = any_value(truth) as a, arg_min(label, (-total / n, label)) = any_value(truth) as b from sc group by q, truth),
o as (select row_number() over (order by md5(q::varchar), q) - 1 as i, (a::int - b::int)::double as v, count(*) over () as n from b),
d as (select b as replicate, j, ('0x' || substring(md5('0|' || b::varchar || '|' || j::varchar), 1, 8))::bigint % (select max(n) from o) as i from range(2000) x(b), range((select max(n) from o)) y(j)),
m as (select replicate, avg(v) as mean from d join o using (i) group by replicate), t as (select count_if(a and b) as both, count_if(a and not b) as first_only, count_if(b and not a) as second_only, count_if(not a and not b) as neither from b)
select t.*, (select round(quantile_cont(mean, 0.025), 6) from m) as low, (select round(quantile_cont(mean, 0.975), 6) from m) as high from t""")
def q_judges_interval(spark, sf_dir):
    """Two judges of the same rows: the two by two table, and a bootstrap interval of the difference of their accuracies."""
    scores, truth = scored(spark, sf_dir, 1, stats=("best", "total", "n"))
    pick = lambda s: F.min(F.struct((-s).alias("s"), "label"))["label"]
    rows = scores.groupBy("q").agg(pick(F.col("best")).alias("a"), pick(F.col("total") / F.col("n")).alias("b")).join(truth, "q")
    rows = rows.select("q", (F.col("a") == F.col("truth")).alias("a"), (F.col("b") == F.col("truth")).alias("b"))
    a, b = F.col("a"), F.col("b")
    cells = rows.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(b & ~a).alias("second_only"), F.count_if(~a & ~b).alias("neither"))
    means = S.bootstrap_means(rows.select("q", (a.cast("int") - b.cast("int")).alias("gap")), "q", "gap")
    ends = means.agg(*(F.round(F.percentile("mean", F.lit(p)), 6).alias(k) for k, p in (("low", 0.025), ("high", 0.975))))
    return cells.join(ends)  # one row each


@query(f"""with {PAIRS}, p as (select ad.image, a, b, sqrt(pow(x.cx - 4, 2) + pow(x.cy - 4, 2)) as da, sqrt(pow(y.cx - 4, 2) + pow(y.cy - 4, 2)) as db from ad join m x on x.image = ad.image and x.lab = a join m y on y.image = ad.image and y.lab = b)
select image, case when da < db then a else b end as i, case when da < db then b else a end as j from p where da <> db""")
def q_central_edges(spark, sf_dir):
    """Deep edges where regions have no depth: the one nearer to the centre is deeper."""
    cells = X.regions(spark, sf_dir)
    flat = G.region_moments(cells, 4).withColumn("depth", F.lit(None).cast("double"))
    return G.typed_edges(flat, G.adjacent(cells), 8.0, 8.0).where("rel = 'deep'").select("image", "i", "j")


K, ROUNDS = 12, 4
_GAP = " + ".join(f"pow(f[{i}] - g[{i}], 2)" for i in range(1, 6))
_MEAN = ", ".join(f"avg(f[{i}])" for i in range(1, 6))
_STEPS = ", ".join(
    f"""a{j} as (select image, i, any_value(f) as f, arg_min(k, ({_GAP}, k)) as k from ft join c{j} using (image) group by image, i), n{j} as (select image, k, [{_MEAN}] as g from a{j} group by image, k),
c{j + 1} as (select image, k, coalesce(n{j}.g, c{j}.g) as g from c{j} left join n{j} using (image, k))"""
    for j in range(ROUNDS)
)


@query(f"""with t0 as (select vec_id as image, unnest(range(64)) as i, embedding from embeddings), t1 as (select image, i, [embedding[i + 1]::double, embedding[(i + 1) % 64 + 1]::double, embedding[(i + 8) % 64 + 1]::double] as t from t0),
ft as (select image, i, list_concat(list_transform(t, lambda x: x / greatest(sqrt(list_dot_product(t, t)), 1e-12)), [2.0::double * (i // 8) / 8, 2.0::double * (i % 8) / 8]) as f from t1),
c0 as (select image, s.k, f as g from ft join range({K}) s(k) on ft.i = s.k * 64 // {K}), {_STEPS} select image, (i // 8)::int as r, (i % 8)::int as c, (k + 1)::int as lab from a{ROUNDS - 1}""")
def q_image_regions(spark, sf_dir):
    """Regions of each image by k-means over its cells' tokens (a value and its two neighbours) and places."""
    e = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.col("embedding").cast("array<double>").alias("e"))
    at = lambda k: F.get("e", (F.col("i") + k) % 64)
    cells = e.select("image", "e", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select("image", F.expr("int(i div 8)").alias("r"), (F.col("i") % 8).alias("c"), F.array(at(0), at(1), at(8)).alias("token"))
    return G.clustered(cells, K, rounds=ROUNDS)
