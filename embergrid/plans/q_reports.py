"""Reports: pair relations and their ceiling, transfer and recovery between collections, logs of choices, union of frames."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from embergrid.functions import text as T
from embergrid.functions import vectors as V
from embergrid.operators import dedup as D
from embergrid.operators import knn
from embergrid.operators import metrics as M
from embergrid.operators import relations as L
from embergrid.operators import retrieval as R

from . import fixtures as X
from .q_retrieval import SEEDS, _search, scored
from .q_text import NAMES, labels
from .registry import query

#: Names of the ten classes, so that all relations occur.
CLASS_NAMES = ("femoral artery", "femoral vein", "left femoral vein", "deep radial nerve", "superficial radial nerve", "radial artery", "vein of gland", "lateral femoral node", "c5", "ulnar artery")
NAMED = "names(label, name) as (values " + ", ".join(f"({k}, '{v}')" for k, v in enumerate(CLASS_NAMES)) + ")"


def _strings(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_set(name: str, words, keep: bool) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({name}, ' '), lambda t: {'' if keep else 'not '}list_contains({_strings(words)}, t))))"


def _sql_kind(name: str) -> str:
    kinds = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in L.CATEGORIES.items()) + "}"
    return f"coalesce({kinds}[list_filter(string_split({name}, ' '), lambda t: list_contains({_strings(L.CATEGORIES)}, t))[-1]], 'other')"


def _sql_relations(a: str, b: str) -> str:
    """loose, tight, direction and bundle of two names, as columns."""
    clean = L.CATEGORY_WORDS + L.GENERIC
    bare = lambda x: f"list_filter({_sql_set(x, clean, False)}, lambda t: length(t) > 0)"
    apart = f"{_sql_set(a, T.LATERALITY, False)} <> {_sql_set(b, T.LATERALITY, False)}"
    named = f"list_has_any({bare(a)}, {bare(b)})"
    turn = T.DIRECTIONS + T.LATERALITY
    return f"""{a} <> {b} and list_has_any({_sql_set(a, L.CATEGORY_WORDS, False)}, {_sql_set(b, L.CATEGORY_WORDS, False)}) as loose,
 {a} <> {b} and {apart} and {named} as tight, {_sql_set(a, turn, True)} <> {_sql_set(b, turn, True)} as direction,
 {_sql_kind(a)} in ('artery', 'vein', 'nerve') and {_sql_kind(b)} in ('artery', 'vein', 'nerve') and {_sql_kind(a)} <> {_sql_kind(b)} and {apart} and {named} as bundle"""


def _class_names(spark, sf_dir):
    """label, name of the classes that the vectors have."""
    name = F.element_at(F.array(*[F.lit(x) for x in CLASS_NAMES]), (F.col("label") % len(CLASS_NAMES) + 1).cast("int"))
    return X.raw_vectors(spark, sf_dir).select("label").distinct().select("label", name.alias("name"))


@query(f"with {NAMED}, met as (select distinct label from embeddings), x as (select names.name from names join met using (label)) select a.name as a, b.name as b, {_sql_relations('a.name', 'b.name')} from x a join x b on a.name < b.name")
def q_direction_pairs(spark, sf_dir):
    """How each two class names relate: one row for two classes, a vocabulary's size."""
    names = _class_names(spark, sf_dir).select("name")
    both = names.select(F.col("name").alias("a")).join(names.select(F.col("name").alias("b")), F.col("a") < F.col("b"))
    return both.select("a", "b", L.relation(F.col("a"), F.col("b")).alias("r")).select("a", "b", "r.loose", "r.tight", "r.direction", "r.bundle")


@query(f"""with {X.SIGNAL}, {X.scores_sql(SEEDS)}, {NAMED}, r as (select *, row_number() over (partition by seed, q order by best desc, label) as rk from sc),
p as (select seed, q, truth, max(case when rk = 1 then label end) as pred, max(case when label = truth then rk end) as rank_true from r group by all),
e as (select p.*, nt.name as t, np.name as pn from p join names nt on nt.label = p.truth join names np on np.label = p.pred where pred <> truth),
m as (select e.seed, e.q, e.pn, n.name as near, {_sql_relations('e.t', 'n.name')} from e join v o on o.vec_id // 3 = e.q // 3 and o.vec_id <> e.q join names n on n.label = o.label where n.name <> e.t),
k as (select seed, q, bool_or(loose) as loose, bool_or(tight) as tight, coalesce(bool_and(case when tight then direction end), false) as by_direction, bool_or(bundle) as bundle, bool_or(near = pn and tight) as partner from m group by all),
c as (select count(*) as wrong, count_if(loose) as loose, count_if(tight) as tight, count_if(by_direction) as by_direction, count_if(bundle) as bundle, count_if(partner) as partner, count_if(partner and rank_true <= 3) as realistic from e left join k using (seed, q)),
g as (select *, (select count(*) from p) as asked from c)
select wrong, loose, tight, by_direction, bundle, partner, realistic, round(case when tight > 0 then 100.0::double * by_direction / tight else 0 end, 1) as share_by_direction,
 case when round(100.0::double * realistic / asked, 1) < 1 or round(realistic / {SEEDS}.0::double, 1) < 2 then 'STOP' when round(100.0::double * realistic / asked, 1) < 2.5 then 'NARROW' else 'GO' end as gate from g""")
def q_relation_ceiling(spark, sf_dir):
    """What neighbours on the same image could settle, by kind of relation, and whether that is worth while."""
    scores, truth = scored(spark, sf_dir)
    ranks = M.truth_ranks(R.ranked(R.exemplar(scores)), truth)
    names = F.broadcast(_class_names(spark, sf_dir))
    named = lambda df, c: df.join(names.select(F.col("label").alias(c), F.col("name").alias(f"_{c}")), c).drop(c).withColumnRenamed(f"_{c}", c)
    errors = named(named(ranks.where("pred <> truth"), "truth"), "pred")
    images = X.raw_vectors(spark, sf_dir).select(F.expr("vec_id div 3").alias("image"), F.col("vec_id").alias("o"), F.col("label").alias("near"))
    near = named(images, "near").join(images.select("image", F.col("o").alias("q")), "image").where("o <> q").select("q", "near")
    return L.ceiling(errors, near, ranks.count(), SEEDS)


@query(f"""with {X.SIGNAL}, f as (select *, case when vec_id % 4 = 3 then 'out' when unit % 10 < 3 then 'test' else 'gallery' end as part from v),
s as (select a.vec_id as q, a.part, a.label as truth, b.label, max(list_dot_product(a.e, b.e)) as best from f a join f b on b.part = 'gallery' where a.part <> 'gallery' group by all),
r as (select *, row_number() over (partition by q order by best desc, label) as rk from s), t as (select part, q, max(case when label = truth then rk end) as rk from r group by all),
a as (select part, 100.0::double * avg((rk = 1)::int) as top1, 100.0::double * avg((rk <= 5)::int) as top5 from t group by 1)
select round(o.top1, 6) as out_top1, round(i.top1, 6) as in_top1, round(o.top1 / i.top1, 6) as ratio1, round(o.top5 / i.top5, 6) as ratio5 from a o, a i where o.part = 'out' and i.part = 'test'""")
def q_transfer_ratio(spark, sf_dir):
    """Rows from outside and held-out rows of the collection against one gallery: what share of the accuracy carries over."""
    part = F.when(F.col("vec_id") % 4 == 3, "out").when(F.col("unit") % 10 < 3, "test").otherwise("gallery")
    rows = X.signal_vectors(spark, sf_dir).withColumn("part", part).withColumn("mask", F.lit(1))
    asked = rows.where("part <> 'gallery'")
    ranks = M.truth_ranks(R.ranked(R.exemplar(R.class_scores(asked, rows.where("part = 'gallery'"), stats=("best",)))), asked.select(F.lit(0).alias("seed"), F.col("vec_id").alias("q"), F.col("label").alias("truth")))
    top = M.accuracy(ranks.join(asked.select(F.col("vec_id").alias("q"), "part"), "q"), ("part",))
    at = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c)))
    return top.agg(F.round(at("out", "top1"), 6).alias("out_top1"), F.round(at("test", "top1"), 6).alias("in_top1"), F.round(at("out", "top1") / at("test", "top1"), 6).alias("ratio1"), F.round(at("out", "top5") / at("test", "top5"), 6).alias("ratio5"))


@query(f"""with {X.SIGNAL}, s as (select a.vec_id as q, a.vec_id % 2 as side, b.vec_id as g, b.vec_id % 2 as other, list_dot_product(a.e, b.e) as sim from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
n as (select *, row_number() over (partition by q order by sim desc, g) as rk from s), k as (select q, avg((side = other)::int) as own, max(case when rk = 1 then (side = other)::int end) as first from n where rk <= 20 group by all),
b as (select avg((vec_id % 2 = 0)::int) as base from v), t as (select avg(own) as own, avg(first) as first from k)
select round(own, 6) as purity, round(first, 6) as first_own, round(base, 6) as base_rate, case when 1 - own >= 0.6 * base then 'GO' else 'STOP' end as gate from t, b""")
def q_neighbour_purity(spark, sf_dir):
    """Share of the 20 nearest that come from the query's own collection, beside the share a random neighbour would have."""
    asked, gallery = _search(spark, sf_dir)
    near = R.nearest(asked, gallery, 20).withColumn("own", (F.col("q") % 2 == F.col("g") % 2).cast("int"))
    per = near.groupBy("q").agg(F.avg("own").alias("own"), F.max(F.when(F.col("rank") == 1, F.col("own"))).alias("first")).agg(F.avg("own").alias("own"), F.avg("first").alias("first"))
    base = gallery.agg(F.avg((F.col("vec_id") % 2 == 0).cast("int")).alias("base"))
    gate = F.when(1 - F.col("own") >= 0.6 * F.col("base"), "GO").otherwise("STOP")
    return per.join(F.broadcast(base)).select(F.round("own", 6).alias("purity"), F.round("first", 6).alias("first_own"), F.round("base", 6).alias("base_rate"), gate.alias("gate"))


@query("""with x as (select doc_id % 7 = 0 as failed, quality = 1 as seen, toxic = 0 as blind, doc_id % 5 <> 0 as listed from labels where quality is not null and toxic is not null)
select count(*) as asked, round(100.0::double * avg((seen and not failed)::int), 6) as with_image, round(100.0::double * avg(blind::int), 6) as without, round(100.0::double * avg((seen and not failed)::int) - 100.0::double * avg(blind::int), 6) as image_gain,
 round(100.0::double * avg((seen and not failed)::int) - 50, 6) as rerank_gain, round(100.0::double * avg(failed::int), 6) as unreadable, round(avg((seen and not failed)::int) / avg(listed::int), 6) as share_of_ceiling from x""")
def q_choice_gains(spark, sf_dir):
    """Log of choices: what seeing adds to guessing and to the baseline, how many replies could not be read, share of the ceiling."""
    log = X.table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select((F.col("doc_id") % 7 == 0).alias("failed"), (F.col("quality") == 1).alias("seen"), (F.col("toxic") == 0).alias("blind"), (F.col("doc_id") % 5 != 0).alias("listed"))
    return M.choice_gains(log, 50.0)


@query(f"""with {NAMES}, w as (select label, count(*) as n from n where obs_id % 3 = 0 group by 1), k as (select label, count(*) as n from n where obs_id % 2 = 0 group by 1)
select sum(w.n)::bigint as raw, count(*) as raw_distinct, coalesce(sum(case when k.label is not null then w.n end), 0)::bigint as kept, coalesce(sum(case when k.label is null and regexp_matches(w.label, '[0-9]') then w.n end), 0)::bigint as dropped,
 count_if(k.label is null and regexp_matches(w.label, '[0-9]')) as dropped_distinct from w left join k using (label)""")
def q_dropped_labels(spark, sf_dir):
    """Raw labels, those a vocabulary keeps, and those it lacks that are no valid label either."""
    rows = labels(spark, sf_dir)
    return M.label_accounting(rows.where("obs_id % 3 = 0"), rows.where("obs_id % 2 = 0"), ~F.col("label").rlike("[0-9]"))


@query("""with l as (select page_id, case page_id % 5 when 0 then '' when 1 then url when 2 then 'Adobe reader' else 'site ' || page_id::varchar end as label from pages)
select page_id, label from l where label <> '' and not contains(lower(label), 'http') and not contains(lower(label), 'adobe')""")
def q_boilerplate_labels(spark, sf_dir):
    """Empty labels, addresses and the reader's own words are no labels."""
    k = F.col("page_id") % 5
    label = F.when(k == 0, "").when(k == 1, F.col("url")).when(k == 2, "Adobe reader").otherwise(F.concat(F.lit("site "), F.col("page_id").cast("string")))
    return X.table(spark, sf_dir, "pages").select("page_id", label.alias("label")).where(~T.boilerplate(F.col("label")))


FRAMES = "f as (select obs_id, page, image, src, label, x, y, (320 + 64 * (image % 5))::int as w, (240 + 48 * (image % 5))::int as h from pins)"


@query(f"""with {X.PINS}, {FRAMES}, c as (select page, image, w as cw, h as ch, row_number() over (partition by page order by bool_or(src = 'src1') = false, -(w * h), image) as k from f group by page, image, w, h),
m as (select f.obs_id, f.page, c.image as canonical, f.label, round_even(f.x * (c.cw::double / f.w), 0)::int as x, round_even(f.y * (c.ch::double / f.h), 0)::int as y, c.cw as w, c.ch as h, f.image <> c.image as moved from f join c on c.page = f.page and c.k = 1)
select * from m""")
def q_union_points(spark, sf_dir):
    """Points of all frames of a group in the frame of its canonical member."""
    return _union(spark, sf_dir).select("obs_id", "page", "canonical", "label", "x", "y", "w", "h", "moved")


def _union(spark, sf_dir):
    size = F.col("image") % 5
    rows = X.pins(spark, sf_dir).drop("w", "h").withColumn("w", (320 + 64 * size).cast("int")).withColumn("h", (240 + 48 * size).cast("int"))
    return D.mapped_points(rows, "page", "image", F.col("src") == "src1", F.col("w") * F.col("h"))


@query()
def q_union_dedup(spark, sf_dir):
    """The chain: points in the canonical frame, then of those of one label that stand close the first stays. Tested against a loop."""
    return D.greedy_points(_union(spark, sf_dir), ["page", "label"], ["obs_id"], 60)


@query(f"""with {X.SIGNAL}, t as (select distinct label, list_transform(range(64), lambda i: case when i % 10 = label then 1.0::double else 0.0::double end) as u from v),
s as (select vec_id, v.label as truth, t.label, list_dot_product(e, u) / sqrt(list_dot_product(u, u)) as score from v, t), r as (select *, row_number() over (partition by vec_id order by round(score, 9) desc, label) as rk from s)
select vec_id, truth, label as pred, round(score, 6) as score from r where rk = 1""")
def q_text_prototypes(spark, sf_dir):
    """One given vector a class, as a text encoder has them: the nearest by cosine. A vocabulary is sent to all tasks up to a size, and joined by pivots beyond."""
    rows = X.signal_vectors(spark, sf_dir)
    means = rows.select("label").distinct().withColumn("u", F.transform(F.sequence(F.lit(0), F.lit(X.DIMS - 1)), lambda i: F.when(i % 10 == F.col("label"), 1.0).otherwise(0.0)))
    best = knn.best_classes(rows.select(F.col("vec_id").alias("q"), "e"), means.select("label", V.scaled(F.col("u"), 1 / V.norm(F.col("u"))).alias("e")), 1)
    return best.select("q", F.col("label").alias("pred"), "sim").join(rows.select(F.col("vec_id").alias("q"), F.col("label").alias("truth")), "q").select(F.col("q").alias("vec_id"), "truth", "pred", F.round("sim", 6).alias("score"))


@query(f"""with {X.PINS}, g as (select obs_id, unnest(range(1, 4)) as k, x, y, w, h from pins) select obs_id, k::int as variant, greatest(0.0::double, least(w - 1.0::double, x + 10.0::double * k)) as x, greatest(0.0::double, least(h - 1.0::double, y - 5.0::double * k)) as y from g""")
def q_point_variants(spark, sf_dir):
    """One record becomes three: its point moved by steps, held in the frame."""
    k = F.col("variant")
    rows = X.pins(spark, sf_dir).withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(3))))
    clip = lambda v, size: F.greatest(F.lit(0.0), F.least(size - 1.0, v))
    return rows.select("obs_id", "variant", clip(F.col("x") + 10.0 * k, F.col("w")).alias("x"), clip(F.col("y") - 5.0 * k, F.col("h")).alias("y"))


def _first_word(prompts: pd.Series) -> pd.Series:
    """A backend that reads its prompt: answers with the first word, the surer the longer the prompt (up to a hundred characters, then from the start)."""
    said = [(re.search("[A-Za-z]+", p or ""), len(p or "")) for p in prompts]
    return pd.Series([f"ANSWER: {m[0] if m else 'none'} CONF: {n % 100 / 100:.2f}" for m, n in said], dtype=object)


@query("""with p as (select conv_id, turn, coalesce(text, '') as t from conversations) select conv_id, turn, coalesce(nullif(regexp_extract(t, '[A-Za-z]+'), ''), 'none') as answer, (length(t) % 100) / 100.0::double as conf from p""")
def q_backend_replies(spark, sf_dir):
    """Prompts through a text backend, and what is parsed of its replies. The library's default backend declines, so that plans run without a model."""
    rows = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("prompt"))
    return T.replies(rows, "prompt", _first_word).select("conv_id", "turn", T.parse_answer(F.col("reply")).alias("a")).select("conv_id", "turn", "a.*")


SPLIT_GAP = f"""with {X.SIGNAL}, f as (select *, (vec_id // 75) as src from v), p as (select *, unit % 10 < 3 as is_test from f), s as (select *, src % 5 = 0 as is_test from f),
a as (select q.vec_id, q.label as truth, g.label, max(list_dot_product(q.e, g.e)) as best from p q join p g on q.is_test and not g.is_test group by all), b as (select q.vec_id, q.label as truth, g.label, max(list_dot_product(q.e, g.e)) as best from s q join s g on q.is_test and not g.is_test group by all),
m as (select src, list_transform(range(64), lambda i: avg_e[i + 1]) as mean from (select src, list(avg_i order by i) as avg_e from (select src, i, avg(e[i + 1]) as avg_i from f, range(64) d(i) group by all) group by 1)),
z0 as (select f.*, list_transform(range(64), lambda i: e[i + 1] - mean[i + 1]) as d from f join m using (src)), z as (select vec_id, label, src % 5 = 0 as is_test, list_transform(d, lambda x: x / (sqrt(list_dot_product(d, d)) + 1e-9)) as e from z0),
c as (select q.vec_id, q.label as truth, g.label, max(list_dot_product(q.e, g.e)) as best from z q join z g on q.is_test and not g.is_test group by all),
t as (select k, 100.0::double * avg((label = truth)::int) as top1 from (select *, row_number() over (partition by k, vec_id order by best desc, label) as rk from (select 'a' as k, * from a union all select 'b', * from b union all select 'c', * from c)) where rk = 1 group by 1),
o as (select max(case when k = 'a' then top1 end) as by_unit, max(case when k = 'b' then top1 end) as by_source, max(case when k = 'c' then top1 end) as centred from t)
select round(by_unit, 1) as by_unit, round(by_source, 1) as by_source, round(centred, 1) as centred, round(by_unit - by_source, 1) as gap, round(centred - by_source, 1) as recovery, round(by_unit - by_source, 1) > 0 and round(centred - by_source, 1) >= 0.5 * round(by_unit - by_source, 1) as passed from o"""


@query(SPLIT_GAP)
def q_source_recovery(spark, sf_dir):
    """What splitting by source costs against splitting by unit, and whether centring by source wins half of it back."""
    rows = X.signal_vectors(spark, sf_dir).withColumn("src", F.expr("vec_id div 75"))
    mean = rows.groupBy("src").agg(F.array(*[F.avg(F.col("e")[i]) for i in range(X.DIMS)]).alias("mean"))
    centred = rows.join(mean, "src").withColumn("e", V.unit(F.zip_with("e", "mean", lambda x, y: x - y))).drop("mean")

    def top1(table, test, name):
        table = table.withColumn("mask", F.lit(1))
        scores = R.class_scores(table.where(test), table.where(~test), stats=("best",))
        best = R.ranked(R.exemplar(scores)).where("rank = 1").select("q", "label")
        return best.join(rows.select(F.col("vec_id").alias("q"), F.col("label").alias("truth")), "q").agg((100.0 * F.avg((F.col("label") == F.col("truth")).cast("int"))).alias(name))

    by_unit, by_source = F.col("unit") % 10 < 3, F.col("src") % 5 == 0
    one = top1(rows, by_unit, "u").join(top1(rows, by_source, "s")).join(top1(centred, by_source, "c"))
    gap, back = F.round(F.col("u") - F.col("s"), 1), F.round(F.col("c") - F.col("s"), 1)
    return one.select(F.round("u", 1).alias("by_unit"), F.round("s", 1).alias("by_source"), F.round("c", 1).alias("centred"), gap.alias("gap"), back.alias("recovery"), ((gap > 0) & (back >= 0.5 * gap)).alias("passed"))
