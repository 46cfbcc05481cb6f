"""Grouping, union, relations, vectors, sources and stream twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embergrid.functions import text as T
from embergrid.functions import vectors as V
from embergrid.operators import components as CC
from embergrid.operators import dedup as D
from embergrid.operators import metrics as M
from embergrid.operators import relations as L
from embergrid.operators import retrieval as R
from embergrid.operators import similarity as S
from embergrid.sources import records as IO
from embergrid.sources.shared import staged
from embergrid.streaming import streams

from . import fixtures as X
from .q_retrieval import SEEDS, scored
from .q_text import NAMES, TOKS, labels
from .registry import query


@query("select sha256(coalesce(text, '')) as sha, min(doc_id) as canonical, count(*) as copies from documents group by 1")
def q_exact_dup_groups(spark, sf_dir):
    return D.content_groups(X.table(spark, sf_dir, "documents"), "doc_id", "text")


@query("with g as (select count(*) as n from documents group by text) select count(*) as groups, sum((n > 1)::int)::bigint as multi, sum(n - 1)::bigint as removed from g")
def q_group_statistics(spark, sf_dir):
    groups = D.content_groups(X.table(spark, sf_dir, "documents"), "doc_id", "text")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("copies") > 1).alias("multi"), F.sum(F.col("copies") - 1).alias("removed"))


TWINS = """tw as (select vec_id, embedding as e0, list_transform(embedding, lambda x: x::double) as e from embeddings union all select 1000000 + vec_id, null, list_transform(range(64), lambda i: embedding[i + 1]::double + 0.01::double * ((i * 7) % 5 - 2)) from embeddings where vec_id % 10 = 0),
hs as (select vec_id, e, list_sum(list_transform(range(56), lambda k: (case when e[k + k // 7 + 2] > e[k + k // 7 + 1] then 1::bigint else 0::bigint end) << (55 - k)))::bigint as h from tw)"""


def twins(spark, sf_dir) -> DataFrame:
    rows = X.raw_vectors(spark, sf_dir).select("vec_id", "e")
    copies = rows.where("vec_id % 10 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), F.transform("e", lambda x, i: x + 0.01 * ((i * 7) % 5 - 2)).alias("e"))
    return rows.unionByName(copies)


def _near(rows: DataFrame) -> DataFrame:
    """Hamming candidates with their correlation."""
    return D.hamming_pairs(rows.withColumn("h", D.difference_hash(F.col("e"), 8)), "vec_id", "h", 12, vector="e")


@query(f"with {TWINS} select vec_id, h from hs")
def q_difference_hash(spark, sf_dir):
    return twins(spark, sf_dir).select("vec_id", D.difference_hash(F.col("e"), 8).alias("h"))


HAM = f"with recursive {TWINS}, hp as (select x.vec_id as a, y.vec_id as b, bit_count(xor(x.h, y.h))::int as distance, x.e as ea, y.e as eb from hs x join hs y on x.vec_id < y.vec_id and bit_count(xor(x.h, y.h)) <= 12)"
CORR = "(list_dot_product(ea, eb) / 64 - list_sum(ea) / 64 * list_sum(eb) / 64) / sqrt((list_dot_product(ea, ea) / 64 - pow(list_sum(ea) / 64, 2)) * (list_dot_product(eb, eb) / 64 - pow(list_sum(eb) / 64, 2)))"


@query(f"{HAM} select a, b, distance, round({CORR}, 6) as corr from hp")
def q_hamming_pairs(spark, sf_dir):
    return _near(twins(spark, sf_dir)).select("a", "b", "distance", F.round("corr", 6).alias("corr"))


COMP = f"""{HAM}, ed as (select a, b from hp where {CORR} >= 0.9 union all select b, a from hp where {CORR} >= 0.9), walk(node, seen) as (select vec_id, vec_id from tw union select walk.node, ed.b from walk join ed on ed.a = walk.seen), blocks as (select node as vec_id, min(seen) as block from walk group by node)"""


def _blocks(spark, sf_dir) -> DataFrame:
    """Copies of one vector are linked with the first of them, which alone is compared with others."""
    rows = staged(twins(spark, sf_dir), "twins")
    known = rows.where("e is not null")
    firsts = staged(known.groupBy("e").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    near = _near(firsts.withColumnRenamed("first", "vec_id")).where("corr >= 0.9").select("a", "b")
    copies = known.join(firsts.where("n > 1"), "e").where("vec_id <> first").select(F.col("first").alias("a"), F.col("vec_id").alias("b"))
    return CC.group_of(rows.select("vec_id"), "vec_id", staged(near.unionByName(copies), "links"))


@query(f"{COMP} select vec_id, block from blocks")
def q_components(spark, sf_dir):
    return _blocks(spark, sf_dir)


@query(f"{COMP}, s as (select block, (vec_id >= 1000000)::int as side from blocks) select count(distinct block) as blocks, count(distinct case when side = 1 then block end) as with_twin, (select count(*) from (select block from s group by block having count(distinct side) = 2)) as both from s")
def q_twin_audit(spark, sf_dir):
    """Share of blocks with members on both sides: what a split by row would leak."""
    rows = _blocks(spark, sf_dir).withColumn("side", (F.col("vec_id") >= 1000000).cast("int"))
    per = rows.groupBy("block").agg(F.countDistinct("side").alias("sides"), F.max("side").alias("late"))
    return per.agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("late") == 1).alias("with_twin"), F.count_if(F.col("sides") == 2).alias("both"))


@query(f"{HAM} select count(distinct case when b >= 1000000 then b end)::double / (select count(*) from tw where vec_id >= 1000000) as overlap from hp where a < 1000000")
def q_collection_overlap(spark, sf_dir):
    rows = twins(spark, sf_dir)
    pairs = D.hamming_pairs(rows.withColumn("h", D.difference_hash(F.col("e"), 8)), "vec_id", "h", 12)
    total = rows.agg(F.count_if(F.col("vec_id") >= 1000000).alias("n"))
    met = pairs.where("a < 1000000 and b >= 1000000").agg(F.countDistinct("b").alias("k"))
    return met.join(total).select((F.col("k") / F.col("n")).alias("overlap"))


@query(f"""with {X.PINS}, g as (select page, src, obs_id, w * h - obs_id as area from pins), r as (select *, row_number() over (partition by page order by src <> 'src1', -area, obs_id) as k, count(*) over (partition by page) as members from g) select page, obs_id as canonical, members from r where k = 1""")
def q_canonical_member(spark, sf_dir):
    p = X.pins(spark, sf_dir).withColumn("area", F.col("w") * F.col("h") - F.col("obs_id"))
    return D.canonical(p, "page", "obs_id", F.col("src") == "src1", F.col("area"))


@query()
def q_point_dedup(spark, sf_dir):
    """Order-dependent: a point goes if a kept one of the same page and label is near. Tested against a loop."""
    return D.greedy_points(X.pins(spark, sf_dir), ["page", "label"], ["obs_id"], 250)


@query(f"with {X.PINS} select obs_id, src || ':' || page::varchar || '#' || image::varchar as unit_key from pins")
def q_unit_keys(spark, sf_dir):
    return X.pins(spark, sf_dir).select("obs_id", F.concat_ws("", "src", F.lit(":"), F.col("page").cast("string"), F.lit("#"), F.col("image").cast("string")).alias("unit_key"))


@query(f"with {X.PINS}, d as (select distinct image from pins) select image, lpad((row_number() over (order by image) - 1)::varchar, 5, '0') as number from d")
def q_renumber(spark, sf_dir):
    return IO.renumber(X.pins(spark, sf_dir), "image")


@query(f"with {X.PINS}, c as (select image, count(*) as n from pins where x >= 0 and y >= 0 and x < w and y < h group by image) select n, count(*) as images from c group by n")
def q_pins_per_image(spark, sf_dir):
    rows = X.pins(spark, sf_dir).where("x >= 0 and y >= 0 and x < w and y < h").groupBy("image").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("n").agg(F.count(F.lit(1)).alias("images"))


@query(f"with {X.PINS} select a.obs_id, count(*) as neighbours, list_sort(list(distinct b.label)) as labels from pins a join pins b on a.image = b.image and a.obs_id <> b.obs_id and a.label <> b.label group by a.obs_id")
def q_copresence(spark, sf_dir):
    p = X.pins(spark, sf_dir).select("obs_id", "image", "label")
    b = p.select("image", F.col("obs_id").alias("o"), F.col("label").alias("l"))
    return p.join(b, "image").where("obs_id <> o and label <> l").groupBy("obs_id").agg(F.count(F.lit(1)).alias("neighbours"), F.array_sort(F.collect_set("l")).alias("labels"))


@query(f"""with {X.SIGNAL}, {X.scores_sql(SEEDS)}, r as (select *, row_number() over (partition by seed, q order by best desc, label) as rk from sc), p as (select seed, q, truth, max(case when rk = 1 then label end) as pred, max(case when label = truth then rk end) as rank_true from r group by all),
n as (select p.*, exists (select 1 from v o where o.vec_id // 3 = p.q // 3 and o.vec_id <> p.q and o.label = p.pred) as partner from p where pred <> truth)
select (select count(*) from p) as asked, count(*) as wrong, sum(partner::int)::bigint as partner, sum((partner and rank_true <= 3)::int)::bigint as realistic from n""")
def q_copresence_ceiling(spark, sf_dir):
    """Errors that a co-present neighbour could settle: the prediction is itself on the image, and the truth ranks among three."""
    scores, truth = scored(spark, sf_dir)
    ranks = M.truth_ranks(R.ranked(R.exemplar(scores)), truth)
    present = X.raw_vectors(spark, sf_dir).select(F.expr("vec_id div 3").alias("image"), F.col("vec_id").alias("o"), F.col("label").alias("pred"))
    met = ranks.where("pred <> truth").withColumn("image", F.expr("q div 3")).join(present, ["image", "pred"]).where("o <> q").select("seed", "q").distinct().withColumn("partner", F.lit(True))
    rows = ranks.join(met, ["seed", "q"], "left")
    hit = F.coalesce("partner", F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("pred") != F.col("truth")).alias("wrong"), F.count_if(hit).alias("partner"), F.count_if(hit & (F.col("rank_true") <= 3)).alias("realistic"))


def _vocab(spark, sf_dir) -> DataFrame:
    return labels(spark, sf_dir).select("label").distinct()


@query()
def q_near_dup_blocks(spark, sf_dir):
    """Ratcliff-Obershelp over token blocks: no SQL twin; tested against all pairs."""
    return S.near_duplicates(_vocab(spark, sf_dir), L.CATEGORY_WORDS + L.GENERIC)


@query()
def q_cross_source_near_dups(spark, sf_dir):
    """Near duplicates whose spellings come from different sources."""
    rows = labels(spark, sf_dir)
    where = rows.groupBy("label").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    pairs = S.near_duplicates(where.select("label"), L.CATEGORY_WORDS + L.GENERIC)
    out = pairs.join(where.select(F.col("label").alias("a"), F.col("sources").alias("sa")), "a").join(where.select(F.col("label").alias("b"), F.col("sources").alias("sb")), "b")
    return out.where(F.col("sa") != F.col("sb")).select("a", "b", F.round("ratio", 6).alias("ratio"), F.array_join("sa", "+").alias("from_a"), F.array_join("sb", "+").alias("from_b"))


@query()
def q_canonicalise(spark, sf_dir):
    counts = labels(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return S.canonicalise(counts, valid=lambda c: F.length(c) >= 4)


@query()
def q_merge_log(spark, sf_dir):
    counts = labels(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return S.canonicalise(counts, valid=lambda c: F.length(c) >= 4).where("canonical <> label and canonical <> ''").select("label", "canonical", F.round("score", 3).alias("score"))


@query()
def q_recoverable(spark, sf_dir):
    rows = labels(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return S.recoverable(rows.where("n < 3"), rows.where("n >= 3").select("label"))


@query()
def q_free_text(spark, sf_dir):
    rows = labels(spark, sf_dir).withColumn("true", F.first("label").over(W.partitionBy(F.expr("obs_id div 8")).orderBy("obs_id")))
    return S.free_text_correct(rows, "label_raw", "true").groupBy("source").agg(F.avg(F.col("correct").cast("int")).alias("correct"), F.count(F.lit(1)).alias("n"))


def _sql_set(label: str, words) -> str:
    return f"list_sort(list_distinct(list_filter({TOKS.format(label)}, lambda t: t not in ({', '.join(repr(w) for w in words)}))))"


@query(f"""with {NAMES}, w as (select obs_id, label as a, lead(label) over (order by obs_id) as b from n), s as (select obs_id, a, b, {_sql_set('a', L.CATEGORY_WORDS + L.GENERIC)} as na, {_sql_set('b', L.CATEGORY_WORDS + L.GENERIC)} as nb, {_sql_set('a', T.LATERALITY)} as la, {_sql_set('b', T.LATERALITY)} as lb, {_sql_set('a', L.CATEGORY_WORDS)} as ca, {_sql_set('b', L.CATEGORY_WORDS)} as cb from w where b is not null)
select obs_id, a <> b and la <> lb and list_has_any(na, nb) as tight, a <> b and list_has_any(ca, cb) as loose, la = lb as near from s""")
def q_pair_relations(spark, sf_dir):
    rows = labels(spark, sf_dir)
    nxt = rows.select((F.col("obs_id") - 1).alias("obs_id"), F.col("label").alias("b"))  # ids are dense here
    pairs = rows.select("obs_id", F.col("label").alias("a")).join(nxt, "obs_id")
    return pairs.select("obs_id", L.relation(F.col("a"), F.col("b")).alias("r")).select("obs_id", "r.tight", "r.loose", "r.near")


# -- vectors


@query(f"""with {X.RAW}, m as (select i, avg(e[i + 1]) as m, stddev_pop(e[i + 1]) as s from v, range(64) d(i) group by i), z as (select vec_id, i, v.e[i + 1] - m as c, (v.e[i + 1] - m) / (s + 1e-6) as z from v, m) select vec_id, round(sum(c * c), 6) as centred, round(sum(abs(z)), 5) as zscored from z group by vec_id""")
def q_centre_zscore(spark, sf_dir):
    rows = X.raw_vectors(spark, sf_dir)
    stat = rows.agg(F.array(*[F.avg(F.col("e")[i]) for i in range(X.DIMS)]).alias("m"), F.array(*[F.stddev_pop(F.col("e")[i]) for i in range(X.DIMS)]).alias("s"))
    rows = rows.join(F.broadcast(stat)).withColumn("c", V.minus(F.col("e"), F.col("m")))
    z = F.zip_with("c", "s", lambda x, s: F.abs(x / (s + 1e-6)))
    return rows.select("vec_id", F.round(V.dot(F.col("c"), F.col("c")), 6).alias("centred"), F.round(F.aggregate(z, F.lit(0.0), lambda a, x: a + x), 5).alias("zscored"))


@query(f"""with {X.RAW}, g as (select unit, i, avg(e[i + 1]) as m from v, range(64) d(i) group by all), x as (select vec_id, list(v.e[i + 1] - m order by i) as e from v join g using (unit) group by vec_id) select vec_id, round(sqrt(list_dot_product(e, e)), 6) as length, round(e[1] / (sqrt(list_dot_product(e, e)) + 1e-9), 6) as first from x""")
def q_context_removed(spark, sf_dir):
    rows = X.raw_vectors(spark, sf_dir)
    means = R.class_means(rows, X.DIMS, normal=False, by=("unit",)).select("unit", "mean")
    rows = rows.join(means, "unit").withColumn("e", V.minus(F.col("e"), F.col("mean")))
    return rows.select("vec_id", F.round(V.norm(F.col("e")), 6).alias("length"), F.round(V.unit(F.col("e"))[0], 6).alias("first"))


@query(f"""with {X.SIGNAL}, w as (select vec_id, list_concat(list_transform(e, lambda x: 0.6::double * x), list_transform(list_reverse(e), lambda x: 0.8::double * x)) as f from v) select vec_id, len(f) as dims, round(f[1] / (sqrt(list_dot_product(f, f)) + 1e-9), 6) as first, round(f[128] / (sqrt(list_dot_product(f, f)) + 1e-9), 6) as last from w""")
def q_weighted_fusion(spark, sf_dir):
    rows = X.signal_vectors(spark, sf_dir).withColumn("f", V.fuse(F.col("e"), F.reverse("e"), weights=(0.6, 0.8)))
    return rows.select("vec_id", F.size("f").cast("long").alias("dims"), F.round(F.col("f")[0], 6).alias("first"), F.round(F.col("f")[127], 6).alias("last"))


@query(f"""with {X.SIGNAL}, w as (select vec_id, list_transform(range(64), lambda i: e[i + 1] + e[64 - i]) as f, case when label % 2 = 0 then e else list_reverse(e) end as p from v) select vec_id, round(f[1] / (sqrt(list_dot_product(f, f)) + 1e-9), 6) as mean_view, round(p[1], 6) as policy from w""")
def q_views(spark, sf_dir):
    e = F.col("e")
    return X.signal_vectors(spark, sf_dir).select("vec_id", F.round(V.unit(V.plus(e, F.reverse(e)))[0], 6).alias("mean_view"), F.round(F.when(F.col("label") % 2 == 0, e).otherwise(F.reverse(e))[0], 6).alias("policy"))


@query(f"""with {X.RAW}, cm as (select label, i, avg(e[i + 1]) as m from v, range(64) d(i) group by all), um as (select i, avg(m) as m from cm group by i) select i::int as i, round(m, 6) as m from um""")
def q_class_uniform_mean(spark, sf_dir):
    means = R.class_means(X.raw_vectors(spark, sf_dir), X.DIMS, normal=False)
    return means.agg(F.array(*[F.avg(F.col("mean")[i]) for i in range(X.DIMS)]).alias("m")).select(F.posexplode("m").alias("i", "m")).select("i", F.round("m", 6).alias("m"))


@query(f"with {X.PINS} select obs_id, round(sin(pi() * (x / 640.0::double)), 6) as s0, round(cos(2 * pi() * (y / 480.0::double)), 6) as c1 from pins")
def q_fourier(spark, sf_dir):
    f = V.fourier(F.array(F.col("x") / 640.0, F.col("y") / 480.0), 2)
    return X.pins(spark, sf_dir).select("obs_id", f.alias("f")).select("obs_id", F.round(F.col("f")[0], 6).alias("s0"), F.round(F.col("f")[7], 6).alias("c1"))


U = "((('0x' || substring(md5(obs_id::varchar || '|{}'), 1, 8))::bigint)::double + 0.5) / 4294967296.0::double"


@query(f"with {X.PINS} select obs_id, round(greatest(0.0, least(639.0, x + 20 * sqrt(-2 * ln({U.format('a')})) * cos(2 * pi() * {U.format('b')}))), 5) as jx from pins")
def q_point_jitter(spark, sf_dir):
    key = F.col("obs_id").cast("string")
    jx = V.jitter(F.col("x"), V.md5_uniform(key, F.lit("a")), V.md5_uniform(key, F.lit("b")), 20.0, 0.0, 639.0)
    return X.pins(spark, sf_dir).select("obs_id", F.round(jx, 5).alias("jx"))


# -- sources and streams


@query(f"with {X.PINS}, c as (select label, count(*) as n from pins where obs_id % 7 <> 0 group by label) select obs_id from pins where obs_id % 7 <> 0 and label in (select label from c where n >= 40)".replace(" where obs_id % 7 <> 0 group", " group").replace("where obs_id % 7 <> 0 and label", "where label"))
def q_core_rows(spark, sf_dir):
    return IO.core(X.pins(spark, sf_dir), "label", 40).select("obs_id")


@query(f"with {X.PINS} select count(*) as unmatched from embeddings where vec_id not in (select obs_id from pins where x >= 0)")
def q_unmatched_vectors(spark, sf_dir):
    records = X.pins(spark, sf_dir).where("x >= 0").select(F.col("obs_id").alias("vec_id"))
    return IO.unmatched_vectors(X.table(spark, sf_dir, "embeddings"), records).agg(F.count(F.lit(1)).alias("unmatched"))


@query("select page_id, sha256(html) as sha256, octet_length(encode(html))::bigint as bytes from (select *, row_number() over (partition by url order by page_id) as k from pages) where k = 1 and page_id % 3 <> 0")
def q_manifest_increment(spark, sf_dir):
    """Pages that a manifest (every third one) does not hold, the first of each url, with digest and size."""
    pages = X.table(spark, sf_dir, "pages")
    first = IO.first_per_key(pages.select("page_id", "url", "html"), ["url"], ["page_id"])
    known = pages.where("page_id % 3 = 0").select("page_id")
    return IO.new_rows(known, first, "page_id").withColumn("content", F.col("html").cast("binary")).select("page_id", *IO.content_row())


@query(f"with {X.PINS} select vec_id from embeddings where vec_id // 3 not in (select image from pins where y < 100)")
def q_orphans(spark, sf_dir):
    resources = X.table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 3").alias("image"))
    return IO.orphans(resources, X.pins(spark, sf_dir).where("y < 100"), "image").select("vec_id")


@query("select source, count(*) as n, count(text) as texts, count(title) as titles from (select 'docs' as source, text, null as title from documents union all select 'talks', text, role from conversations) group by source")
def q_union_sources(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select("text")
    talks = X.table(spark, sf_dir, "conversations").select("text", F.col("role").alias("title"))
    return IO.union_sources({"docs": docs, "talks": talks}).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"), F.count("title").alias("titles"))


@query("select doc_id, l.quality = 1 and not l.toxic = 1 as both_good, case when l.quality = 1 then 1 else 0 end + case when l.toxic = 0 then 1 else 0 end as judges from documents d join labels l using (doc_id)".replace("select doc_id, l.quality = 1 and not l.toxic = 1 as both_good, case when l.quality = 1 then 1 else 0 end + case when l.toxic = 0 then 1 else 0 end as judges from", "select lang as category, round(avg(l.quality), 6) as first, round(avg(1 - l.toxic), 6) as second, round(avg((l.quality = 1 and l.toxic = 0)::int), 6) as both, count(*) as n from") + " group by lang")
def q_two_judges(spark, sf_dir):
    """Two judges of the same items: accuracy of each, and of both, by category."""
    rows = X.table(spark, sf_dir, "documents").select("doc_id", "lang").join(X.table(spark, sf_dir, "labels"), "doc_id")
    both = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    return rows.groupBy(F.col("lang").alias("category")).agg(F.round(F.avg("quality"), 6).alias("first"), F.round(F.avg(1 - F.col("toxic")), 6).alias("second"), F.round(F.avg(both), 6).alias("both"), F.count(F.lit(1)).alias("n"))


@query(f"""with {X.SIGNAL}, sims as (select q.vec_id as q, g.label, max(list_dot_product(q.e, g.e)) as s from v q, v g where q.vec_id % 50 = 0 and q.vec_id <> g.vec_id group by all), x as (select q, label, exp(15 * s) / sum(exp(15 * s)) over (partition by q) as p from sims)
select q, arg_min(label, (-p, label)) as pred, round(max(p), 6) as prob, round(sum(-p * log2(p)), 6) as entropy_bits, max(p) < 0.4 or sum(-p * log2(p)) > 2.5 as abstain from x group by q""")
def q_stream_scoring_batch_twin(spark, sf_dir):
    rows = X.signal_vectors(spark, sf_dir)
    out = streams.answer(rows.where("vec_id % 50 = 0"), rows)
    return out.select("q", "pred", F.round("prob", 6).alias("prob"), F.round("entropy_bits", 6).alias("entropy_bits"), "abstain")


@query("select date_trunc('day', ts)::timestamp as day, user_id % 4 as category, count(*) as n, round(avg((event_type <> 'error')::int), 6) as accuracy from events group by all")
def q_running_accuracy(spark, sf_dir):
    events = X.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4).alias("category"), (F.col("event_type") != "error").alias("correct"))
    return streams.running_accuracy(events).select("day", "category", "n", F.round("accuracy", 6).alias("accuracy"))
