"""Words and boxes, contexts, enrolment, full evaluation records."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embergrid.functions import text as T
from embergrid.functions import vectors as V
from embergrid.operators import calibration as C
from embergrid.operators import components as CC
from embergrid.operators import linear as LC
from embergrid.operators import metrics as M
from embergrid.operators import retrieval as R
from embergrid.operators import spatial as G
from embergrid.sources.shared import staged

from . import fixtures as X
from .q_calibration import CONF, SCALE
from .q_retrieval import SEEDS, _search, scored
from .q_spatial import CELLS
from .q_text import NAMES, labels
from .registry import query

CELL = f"with {X.PINS}, b as (select page, round_even(x / 30.0::double, 0)::bigint as u, round_even(y / 30.0::double, 0)::bigint as t, obs_id, (obs_id * 7) % 11 as conf from pins)"


@query(f"{CELL} select page, u, t, arg_min(obs_id, (-conf, obs_id)) as obs_id, max(conf) as conf from b group by page, u, t")
def q_best_per_cell(spark, sf_dir):
    """The most confident point of each 30-pixel cell; the first wins ties."""
    p = X.pins(spark, sf_dir).withColumn("conf", (F.col("obs_id") * 7) % 11)
    rows = p.groupBy("page", F.bround(F.col("x") / 30.0).cast("long").alias("u"), F.bround(F.col("y") / 30.0).cast("long").alias("t"))
    return rows.agg(F.min(F.struct((-F.col("conf")).alias("c"), "obs_id")).alias("m")).select("page", "u", "t", "m.obs_id", (-F.col("m.c")).alias("conf"))


WORDS = X.PINS + ", wd as (select obs_id, image, x, y, 60 + label * 5 as w, 20 as h, 'w' || obs_id::varchar as t from pins)"
NEAR = "(abs(a.y - b.y) < greatest(a.h, b.h) and b.x - (a.x + a.w) < 120 and a.x - (b.x + b.w) < 120) or (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) > -40 and ((b.y - (a.y + a.h) >= 0 and b.y - (a.y + a.h) < 70) or (a.y - (b.y + b.h) >= 0 and a.y - (b.y + b.h) < 70)))"


@query(f"""with recursive {WORDS}, ed as (select a.obs_id as a, b.obs_id as b from wd a join wd b on a.image = b.image and a.obs_id <> b.obs_id and ({NEAR})), walk(node, seen) as (select obs_id, obs_id from wd union select walk.node, ed.b from walk join ed on ed.a = walk.seen),
g as (select node as obs_id, min(seen) as block from walk group by node) select block, string_agg(t, ' ' order by y, x, t) as text, count(*) as n, min(x) as x0, min(y) as y0, max(x + w) - min(x) as bw from g join wd using (obs_id) group by block""")
def q_word_clusters(spark, sf_dir):
    """Word boxes of one line, or stacked, become one label: predicate edges, components, text in reading order."""
    wd = X.pins(spark, sf_dir).select("obs_id", "image", "x", "y", (60 + F.col("label") * 5).alias("w"), F.lit(20).alias("h"), F.concat(F.lit("w"), F.col("obs_id").cast("string")).alias("t"))
    a, b = wd.alias("a"), wd.alias("b")
    edges = a.join(b, F.col("a.image") == F.col("b.image")).where((F.col("a.obs_id") < F.col("b.obs_id")) & F.expr(NEAR)).select(F.col("a.obs_id").alias("a"), F.col("b.obs_id").alias("b"))
    rows = CC.group_of(wd, "obs_id", edges)
    reading = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "t"))), lambda k: k["t"]), " ")
    return rows.groupBy("block").agg(reading.alias("text"), F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("bw"))


@query(f"with {X.PINS}, {X.REGIONS} select obs_id, lab from pins join cells on cells.image = pins.obs_id and r = least(7, greatest(0, round_even(y / 60.0::double, 0)))::int and c = least(7, greatest(0, round_even(x / 80.0::double, 0)))::int")
def q_point_in_region(spark, sf_dir):
    at = lambda v, s: F.least(F.lit(7), F.greatest(F.lit(0), F.bround(F.col(v) / s))).cast("int")
    p = X.pins(spark, sf_dir).select("obs_id", F.col("obs_id").alias("image"), at("y", 60.0).alias("r"), at("x", 80.0).alias("c"))
    return p.join(X.regions(spark, sf_dir), ["image", "r", "c"]).select("obs_id", "lab")


@query(f"""with {NAMES}, d as (select distinct label, case when label like '% nerve' then 'nerve' when label like '% muscle' then 'muscle' end as cat, array_to_string(list_sort(list_distinct(string_split(regexp_replace(label, ' (nerve|muscle)$', ''), ' '))), ' ') as name from n where label like '% nerve' or label like '% muscle')
select a.label as muscle, b.label as nerve from d a join d b on a.name = b.name and a.cat = 'muscle' and b.cat = 'nerve'""")
def q_same_name_pairs(spark, sf_dir):
    """Labels of two categories whose other words are the same set."""
    d = labels(spark, sf_dir).select("label").distinct().withColumn("cat", F.regexp_extract("label", " (nerve|muscle)$", 1)).where("cat <> ''").withColumn("name", F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace("label", " (nerve|muscle)$", ""), " "))), " "))
    return d.where("cat = 'muscle'").select("name", F.col("label").alias("muscle")).join(d.where("cat = 'nerve'").select("name", F.col("label").alias("nerve")), "name").select("muscle", "nerve")


LOOP = f"""with {X.SIGNAL}, cs as (select label, i, sum(e[i + 1]) as s, count(*) as n from v, range(64) d(i) group by label, i), sv as (select label, list(s order by i) as s, any_value(n) as n from cs group by label),
x as (select q.vec_id as q, q.label as truth, sv.label, list_transform(range(64), lambda i: sv.s[i + 1] - case when q.label = sv.label then q.e[i + 1] else 0.0 end) as p, q.e as e from v q, sv where not (sv.n < 2 and q.label = sv.label)),
sc as (select q, truth, label, list_dot_product(e, p) / greatest(sqrt(list_dot_product(p, p)), 1e-12) as score from x), g as (select s::double as s from range(2, 41) t(s)), y as (select s, q, truth, label, exp(s * score) as z from sc, g), pr as (select s, q, truth, label, z / sum(z) over (partition by s, q) as p from y),
nl as (select s, avg(-ln(p + 1e-12)) as nll from pr where truth = label group by s) select s as scale, round(nll, 6) as nll from nl order by nll, s limit 1"""


@query(LOOP)
def q_loo_prototype_scale(spark, sf_dir):
    """Scale fit on leave-one-out prototypes: the class sum without the row itself, never averaged anew."""
    rows = X.signal_vectors(spark, sf_dir).select("vec_id", "label", "e")
    sums = rows.groupBy(F.col("label").alias("c")).agg(F.array(*[F.sum(F.col("e")[i]) for i in range(X.DIMS)]).alias("s"), F.count(F.lit(1)).alias("n"))
    own = F.col("label") == F.col("c")
    both = rows.join(F.broadcast(sums)).where(~(own & (F.col("n") < 2)))  # one row a class
    proto = F.when(own, V.minus(F.col("s"), F.col("e"))).otherwise(F.col("s"))
    # scored before c takes the name label: inside a lambda the new name would be found first
    scores = both.withColumn("score", V.dot(F.col("e"), V.unit_clamped(proto))).select(F.lit(0).alias("seed"), F.col("vec_id").alias("q"), F.col("c").alias("label"), "score")
    truth = rows.select(F.lit(0).alias("seed"), F.col("vec_id").alias("q"), F.col("label").alias("truth"))
    return C.fit_scale(scores, truth, [float(s) for s in range(2, 41)]).select("scale", F.round("nll", 6).alias("nll"))


@query(f"with {X.SIGNAL} select q.vec_id as q, l.label, round(-ln((select count(distinct label) from v)), 6) as logp from v q, (select distinct label from v) l where q.vec_id % 50 = 0")
def q_uniform_fallback(spark, sf_dir):
    """Without evidence (here: an empty gallery) every label has log probability -ln C."""
    asked, gallery = _search(spark, sf_dir)
    vocabulary = gallery.select("label").distinct()
    scores = R.class_scores(asked, gallery.where("label < 0")).select("q", "label", F.log("best").alias("logp"))
    every = asked.select(F.col("vec_id").alias("q")).join(F.broadcast(vocabulary.withColumn("c", F.count(F.lit(1)).over(W.partitionBy()))))
    return every.join(scores, ["q", "label"], "left").select("q", "label", F.round(F.coalesce("logp", -F.log("c")), 6).alias("logp"))


@query(f"""with {X.PINS}, {CELLS}, l as (select obs_id, v, exp(-(pow(x - cx, 2) + pow(y - cy, 2)) / (2 * 90.0 * 90.0)) as g, (v > 0.1)::int as m from pins join cell on cell.image = pins.obs_id), s as (select obs_id, sum(g * m) as gm, sum(g * m * v) as gmv, sum(g) as g, sum(g * v) as gv, sum(m) as area from l group by obs_id)
select obs_id, round(case when area >= 4 and gm > 1e-6 then gmv / gm else gv / g end, 6) as value from s""")
def q_feathered_pool(spark, sf_dir):
    """Gaussian weights times a mask, or the plain Gaussian where the mask is too small."""
    cells = X.grid(spark, sf_dir).withColumn("cx", (F.col("c") + 0.5) * 80).withColumn("cy", (F.col("r") + 0.5) * 60)
    p = X.pins(spark, sf_dir).select("obs_id", F.col("obs_id").alias("image"), "x", "y").join(cells, "image")
    g = F.exp(-(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) / (2 * 90.0 * 90.0))
    m = (F.col("v") > 0.1).cast("int")
    s = p.groupBy("obs_id").agg(F.sum(g * m).alias("gm"), F.sum(g * m * F.col("v")).alias("gmv"), F.sum(g).alias("g"), F.sum(g * F.col("v")).alias("gv"), F.sum(m).alias("area"))
    return s.select("obs_id", F.round(F.when((F.col("area") >= 4) & (F.col("gm") > 1e-6), F.col("gmv") / F.col("gm")).otherwise(F.col("gv") / F.col("g")), 6).alias("value"))


@query(f"""with {X.REGIONS}, m as (select image, lab, avg(v) as mean from cells where lab > 0 group by image, lab), n as (select distinct a.image, a.lab as a, b.lab as b from cells a join cells b on a.image = b.image and abs(a.r - b.r) + abs(a.c - b.c) = 1 where a.lab > 0 and b.lab > 0 and a.lab <> b.lab),
pt as (select image, lab, arg_min(v, r * 8 + c) as point from cells where lab > 0 group by image, lab), k as (select n.image, a as lab, avg(mean) as around from n join m on m.image = n.image and m.lab = n.b group by n.image, a) select m.image, m.lab, round(mean, 6) as own, round(coalesce(around, 0), 6) as around, [round(point, 6), round(mean, 6)] as with_own, [round(point, 6), round(coalesce(around, 0), 6)] as with_around, [round(point, 6), round(mean, 6), round(coalesce(around, 0), 6)] as with_both from m join pt using (image, lab) left join k using (image, lab)""")
def q_region_contexts(spark, sf_dir):
    """Mean of each region and of its four-neighbour regions (zero without neighbours), alone and beside the value at a point, the region's first cell."""
    cells = X.regions(spark, sf_dir)
    means = cells.where("lab > 0").groupBy("image", "lab").agg(F.avg("v").alias("mean"), F.min_by("v", F.col("r") * 8 + F.col("c")).alias("point"))
    around = G.four_neighbours(cells).join(means.select("image", F.col("lab").alias("b"), "mean"), ["image", "b"]).groupBy("image", F.col("a").alias("lab")).agg(F.avg("mean").alias("around"))
    point, own, near = (V.rounded(c, 6) for c in (F.col("point"), F.col("mean"), F.coalesce("around", F.lit(0.0))))
    return means.join(around, ["image", "lab"], "left").select("image", "lab", own.alias("own"), near.alias("around"), F.array(point, own).alias("with_own"), F.array(point, near).alias("with_around"), F.array(point, own, near).alias("with_both"))


@query(f"""with {CONF}, h as (select seed, q, sum(-p * log2(p)) as bits, max(p) as prob from p where p > 0 group by seed, q), d as (select h.seed, h.q, not (prob < 0.4 or bits > 2.5) as answered, correct from h join conf using (seed, q)),
rk as (select seed, q, truth, label, row_number() over (partition by seed, q order by best desc, label) as rk from sc), tk as (select seed, avg((rk <= 3)::int) as top3, avg((rk <= 5)::int) as top5 from rk where label = truth group by seed),
bn as (select seed, greatest(ceil(conf * 15), 1) as b, count(*) as n, abs(avg(correct::int) - avg(conf)) as gap from conf group by all), ec as (select seed, sum(n * gap) / sum(n) as ece from bn group by seed)
select seed, count(*) as n, round(avg(answered::int), 6) as coverage, round(avg(case when answered then correct::int end), 6) as selective, round(avg(correct::int), 6) as overall, round(any_value(top3), 6) as top3, round(any_value(top5), 6) as top5, round(any_value(ece), 6) as ece from d join tk using (seed) join ec using (seed) group by seed""")
def q_evaluation_record(spark, sf_dir):
    """n, share answered, accuracy of the answered and of all, top 3 and top 5, calibration error."""
    scores, truth = scored(spark, sf_dir)
    probs = C.softmax(R.exemplar(scores), SCALE)
    conf = C.confidences(probs, truth)
    rows = C.decide(probs).join(conf.select("seed", "q", "correct"), ["seed", "q"])
    rank = R.ranked(R.exemplar(scores)).join(truth, ["seed", "q"]).where("label = truth").groupBy("seed")
    tops = rank.agg(*(F.round(F.avg((F.col("rank") <= k).cast("int")), 6).alias(f"top{k}") for k in (3, 5)))
    error = C.ece(conf, 15).select("seed", F.round("ece", 6).alias("ece"))
    right, answered = F.col("correct").cast("int"), ~F.col("abstain")
    return rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(answered.cast("int")), 6).alias("coverage"), F.round(F.avg(F.when(answered, right)), 6).alias("selective"), F.round(F.avg(right), 6).alias("overall")).join(tops, "seed").join(error, "seed")


@query(f"""with {X.SIGNAL}, k as (select unnest([0, 1, 2, 3]) as k), w0 as (select k, vec_id, unit, label, list_transform(range(64), lambda i: e[i + 1] + k * 0.05::double * ((i * 7 + vec_id) % 5 - 2)) as e from v, k where vec_id % 50 = 0), w1 as (select *, sqrt(list_dot_product(e, e)) + 1e-9 as len from w0),
s as (select k, w1.vec_id as q, w1.label as truth, g.label, max(list_dot_product(w1.e, g.e) / len) as s from w1, v g where g.vec_id <> w1.vec_id group by all), r as (select *, row_number() over (partition by k, q order by s desc, label) as rk from s) select k, round(100.0 * avg((label = truth)::int), 6) as top1 from r where rk = 1 group by k""")
def q_noise_curve(spark, sf_dir):
    """Accuracy by strength of noise on the queries: strengths are seeds of one scoring pass."""
    asked, gallery = _search(spark, sf_dir)
    noisy = None
    for k in range(4):
        step = F.transform(F.sequence(F.lit(0), F.lit(X.DIMS - 1)), lambda i: (i * 7 + F.col("vec_id")) % 5 - 2)
        part = asked.withColumn("e", V.unit(V.plus(F.col("e"), V.scaled(step, F.lit(0.05 * k))))).withColumn("mask", F.lit(1 << k))
        noisy = part if noisy is None else noisy.unionByName(part)
    top = R.ranked(R.exemplar(R.class_scores(noisy, gallery.withColumn("mask", F.lit(15)), (0, 1, 2, 3), stats=("best",)))).where("rank = 1")
    truth = asked.select(F.col("vec_id").alias("q"), F.col("label").alias("truth"))
    return top.join(truth, "q").groupBy(F.col("seed").alias("k")).agg(F.round(100.0 * F.avg((F.col("label") == F.col("truth")).cast("int")), 6).alias("top1"))


@query(f"with {X.RAW}, g as (select vec_id, label from v union all select vec_id + 1000000, label from v where vec_id % 3 = 0) select label, count(*) as support, count(distinct vec_id % 1000000) as sources from g group by label")
def q_enrolment(spark, sf_dir):
    """A gallery enrolled from two inputs (vectors, and views of some of them), with support by class."""
    rows = X.raw_vectors(spark, sf_dir).select("vec_id", "label", "e")
    views = rows.where("vec_id % 3 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), "label", F.reverse("e").alias("e"))
    return rows.unionByName(views).groupBy("label").agg(F.count(F.lit(1)).alias("support"), F.countDistinct(F.col("vec_id") % 1000000).alias("sources"))


@query("with d as (select doc_id, quality from labels) select count(*) as docs, count(quality) as labelled from documents left join d using (doc_id)")
def q_sparse_side_table(spark, sf_dir):
    """A side table that covers some rows: the others keep nulls."""
    docs = X.table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(X.table(spark, sf_dir, "labels"), "doc_id", "left").agg(F.count(F.lit(1)).alias("docs"), F.count("quality").alias("labelled"))


@query(f"""with {NAMES}, g as (select obs_id // 8 as k, list_sort(list(distinct label)) as names from n group by 1) select k, 'It lies on: pin ' || k::varchar || '.' || chr(10) || 'It is next to ' || array_to_string(names, ', ') || '.' as text from g""")
def q_serialised_neighbours(spark, sf_dir):
    rows = labels(spark, sf_dir).groupBy(F.expr("obs_id div 8").alias("k")).agg(F.collect_list("label").alias("names"))
    relation = F.array(F.struct(F.lit(1).alias("rel"), F.lit("next to").alias("phrase"), F.col("names")))
    return rows.select("k", T.sentences(F.concat(F.lit("pin "), F.col("k").cast("string")), relation).alias("text"))


@query(f"""with {X.SIGNAL}, tp as (select label, row_number() over (order by count(*) desc, label) as k from v group by label order by k limit 2), r as (select vec_id, (tp.k = 1)::int as cls, unit % 3 as fold, e from v join tp using (label)),
mo as (select fold, cls, i, count(*) as n, sum(e[i + 1]) as s, sum(e[i + 1] * e[i + 1]) as q from r, range(64) d(i) group by all), al as (select cls, i, sum(n) as n, sum(s) as s, sum(q) as q from mo group by cls, i),
wo as (select f.fold, al.cls, al.i, al.n - coalesce(mo.n, 0) as n, al.s - coalesce(mo.s, 0) as s, al.q - coalesce(mo.q, 0) as q from (select distinct fold from mo) f join al on true left join mo on mo.fold = f.fold and mo.cls = al.cls and mo.i = al.i),
va as (select fold, i, sum(q - s * s / n) / sum(n) + 1e-9 as va from wo group by fold, i), ds as (select fold, cls, list(s / n / va order by i) as w, ln(any_value(n)) as ln_n, sum(s / n * s / n / va) as mm from wo join va using (fold, i) group by fold, cls),
sc as (select r.fold, r.vec_id, r.cls, list_dot_product(e, a.w) - list_dot_product(e, b.w) + (a.ln_n - a.mm / 2) - (b.ln_n - b.mm / 2) as score from r join ds a on a.fold = r.fold and a.cls = 1 join ds b on b.fold = r.fold and b.cls = 0),
rk as (select *, row_number() over (partition by fold order by score, -cls) as rk from sc), au as (select fold, (sum(case when cls = 1 then rk end) - sum(cls) * (sum(cls) + 1) / 2.0::double) / (sum(cls) * (count(*) - sum(cls))) as auc from rk group by fold)
select (select label from tp where k = 1) as a, (select label from tp where k = 2) as b, round(avg(auc), 6) as auc, (select count(*) from r) as n from au""")
def q_pairwise_auc(spark, sf_dir):
    """Separability of the two commonest labels: folds by unit, a linear classifier without each fold, area under the curve."""
    rows = X.signal_vectors(spark, sf_dir)
    top = staged(M.top_counts(rows, ["label"], 2).withColumn("k", F.row_number().over(W.orderBy(F.desc("count"), "label"))).select("label", "k"), "top")  # two rows
    rows = staged(rows.join(F.broadcast(top), "label").select("vec_id", "e", (F.col("k") == 1).cast("int").alias("cls"), (F.col("unit") % 3).alias("fold")), "pair")
    found = LC.discriminants(LC.without_fold(LC.moments(rows, X.DIMS), X.DIMS), X.DIMS)
    met = LC.scores(rows.withColumnRenamed("cls", "true"), found)
    margin = met.groupBy("fold", "vec_id", (F.col("true") == 1).alias("positive")).agg(F.sum(F.when(F.col("cls") == 1, F.col("score")).otherwise(-F.col("score"))).alias("score"))
    auc = C.auroc(margin, ("fold",)).agg(F.round(F.avg("auroc"), 6).alias("auc"))
    names = top.agg(F.max(F.when(F.col("k") == 1, F.col("label"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("label"))).alias("b"))
    return names.join(F.broadcast(auc)).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n"))))  # one row each


@query(f"""with {X.SIGNAL}, {X.scores_sql(SEEDS)}, r as (select seed, q, truth, label, row_number() over (partition by seed, q order by best desc, label) as rk from sc) select seed, round(100.0 * avg((label = truth)::int), 6) as top1,
 round(100.0 * avg((label = truth)::int) - (select 100.0 * avg((label = truth)::int) from r where rk = 1), 6) as optimism from r where rk = 1 group by seed""")
def q_optimism(spark, sf_dir):
    """Each seed's accuracy against that of all seeds together."""
    scores, truth = scored(spark, sf_dir)
    top = R.ranked(R.exemplar(scores)).where("rank = 1").join(truth, ["seed", "q"]).withColumn("ok", (F.col("label") == F.col("truth")).cast("int"))
    every = top.agg((100.0 * F.avg("ok")).alias("all"))
    rows = top.groupBy("seed").agg((100.0 * F.avg("ok")).alias("a")).join(F.broadcast(every))
    return rows.select("seed", F.round("a", 6).alias("top1"), F.round(F.col("a") - F.col("all"), 6).alias("optimism"))
