"""Label normalisation, parsing and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embergrid.functions import text as T
from embergrid.operators import metrics as M

from . import fixtures as X
from .registry import query

_ABBR = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.ABBREVIATIONS.items()) + "}"
_PLURAL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.PLURALS.items()) + "}"
_CATS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.CATEGORIES.items()) + "}"
TOKS = "list_filter(string_split_regex({}, '\\s+'), lambda t: t <> '')"
NORM = "array_to_string(list_transform(" + TOKS.format("regexp_replace(regexp_replace(replace(lower(trim(@)), chr(10), ' '), '\\((?:reflected|cut|retracted|removed|partially[^)]*)\\)', '', 'gi'), '[^a-z0-9 ]+', ' ', 'g')") + f", lambda t: coalesce({_ABBR}[t], t)), ' ')"
NAMES = f"{X.LABELS}, n as (select obs_id, source, label_raw, {NORM.replace('@', 'label_raw')} as label from raw_labels)"


def labels(spark, sf_dir) -> DataFrame:
    return X.raw_labels(spark, sf_dir).withColumn("label", T.normalise(F.col("label_raw")))


@query(f"with {NAMES} select obs_id, label from n")
def q_label_normalise(spark, sf_dir):
    return labels(spark, sf_dir).select("obs_id", "label")


LATIN_SQL = "regexp_replace(trim(lower(label_raw)), '\\(.*?\\)', '', 'g')"
for _words, _to in T.LATIN:
    LATIN_SQL = f"regexp_replace({LATIN_SQL}, '\\b({_words})\\b', '{_to}', 'g')"


@query(f"with {X.LABELS} select obs_id, trim(regexp_replace(regexp_replace({LATIN_SQL}, '[^a-z ]', ' ', 'g'), '\\s+', ' ', 'g')) as latin, trim(regexp_replace(regexp_replace(lower(coalesce(label_raw, '')), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) as answer from raw_labels")
def q_label_normalise_variants(spark, sf_dir):
    return X.raw_labels(spark, sf_dir).select("obs_id", T.normalise_latin(F.col("label_raw")).alias("latin"), T.normalise_answer(F.col("label_raw")).alias("answer"))


STRIP = "trim(regexp_replace(label, '(^|\\s)((" + "|".join(T.STATES) + ")(\\s|$))+$', ''))"


@query(f"with {NAMES} select obs_id, {STRIP} as label from n")
def q_strip_state(spark, sf_dir):
    return labels(spark, sf_dir).select("obs_id", T.strip_state(F.col("label")).alias("label"))


@query(f"""with {NAMES}, s as (select obs_id, {STRIP} as label from n), o as (select obs_id, label, array_to_string(list_append(list_slice(string_split(label, ' '), 1, -2), {_PLURAL}[string_split(label, ' ')[-1]]), ' ') as one, {_PLURAL}[string_split(label, ' ')[-1]] as sing from s)
select obs_id, case when sing is not null and one in (select label from s) then one else label end as label from o""")
def q_depluralise(spark, sf_dir):
    rows = labels(spark, sf_dir).select("obs_id", T.strip_state(F.col("label")).alias("label"))
    return T.singular(rows, "label").select("obs_id", "label")


@query(f"""with {NAMES}, f as (select label as was, case when min(obs_id) % 20 = 3 then null else 'nerve ' || label end as now from n where obs_id % 10 = 3 group by label),
a as (select obs_id, coalesce(now, label) as label from n left join f on was = label where was is null or now is not null), s as (select obs_id, {STRIP} as label from a)
select obs_id, coalesce(now, label) as label from s left join f on was = label where was is null or now is not null""")
def q_overrides(spark, sf_dir):
    """An override table with replacements and drops (null), looked up before and after the state words are cut off."""
    rows = labels(spark, sf_dir).select("obs_id", "label")
    fixes = rows.where("obs_id % 10 = 3").groupBy(F.col("label").alias("from")).agg(F.min("obs_id").alias("k"))
    fixes = fixes.select("from", F.when(F.col("k") % 20 != 3, F.concat(F.lit("nerve "), "from")).alias("to"))
    cut = T.fix(rows, "label", fixes).withColumn("label", T.strip_state(F.col("label")))
    return T.fix(cut, "label", fixes)


@query(f"""with {NAMES}, t as (select obs_id, label, {TOKS.format('label')} as t from n) select obs_id, case when length(label) < 4 or not regexp_matches(label, '[aeiou]') then false when len(list_filter(t, lambda x: length(x) >= 3)) = 0 then false when len(t) = 1 and t[1] in ('artery', 'muscle') then false
 when regexp_matches(label, '\\b(muscle|nerve|artery)\\b') then true when len(t) = 1 then t[1] in ('aorta', 'almond') else len(list_filter(t, lambda x: regexp_full_match(x, '[a-z]+') and regexp_matches(x, '[aeiou]'))) >= 2 end as valid, length(trim(label)) < 2 or not regexp_matches(label, '[A-Za-z]') as garbage from t""")
def q_label_validity(spark, sf_dir):
    c = F.col("label")
    return labels(spark, sf_dir).select("obs_id", T.is_valid(c, "muscle|nerve|artery", ("artery", "muscle"), ("aorta", "almond")).alias("valid"), T.is_garbage(c).alias("garbage"))


@query(f"""with {NAMES}, t as (select obs_id, label, {TOKS.format('label')} as t from n), k as (select *, list_filter(t, lambda x: x in ({", ".join(repr(c) for c in T.CATEGORIES)})) as k from t)
select obs_id, case when len(k) > 0 then {_CATS}[k[-1]] else 'other' end as category, case when regexp_matches(lower(label), '{"|".join(T.THIN)}') then 'thin' else 'bulk' end as shape from k""")
def q_label_category(spark, sf_dir):
    return labels(spark, sf_dir).select("obs_id", T.category(F.col("label")).alias("category"), T.thin_or_bulk(F.col("label")).alias("shape"))


@query(f"""with {NAMES} select obs_id, case {" ".join(f"when contains(lower(label), '{w}') then '{v}'" for w, v in T.CATEGORY_RULES)} else 'other' end as category, case {" ".join(f"when contains(lower(label), '{w}') then '{w}'" for w in T.REGIONS)} else 'other' end as region from n""")
def q_label_rules(spark, sf_dir):
    c = F.col("label")
    return labels(spark, sf_dir).select("obs_id", T.first_rule(c, T.CATEGORY_RULES).alias("category"), T.region(c).alias("region"))


_OUT = tuple(T.CATEGORIES) + T.LATERALITY + T.DIRECTIONS


@query(f"""with {NAMES} select obs_id, list_sort(list_distinct(list_filter({TOKS.format('label')}, lambda t: t not in ({", ".join(repr(x) for x in _OUT)}) and length(t) > 1))) as name from n""")
def q_informative_tokens(spark, sf_dir):
    return labels(spark, sf_dir).select("obs_id", F.array_sort(T.informative(F.col("label"), _OUT, 2)).alias("name"))


@query(f"""with {NAMES}, g as (select label, count(*) as n, regexp_matches(label, '[bcdfghjklmnpqrstvwxz]{{4,}}|brachil|\\blac\\b|\\bm\\b$|nerv$|arter$', 'i') or length(label) < 3 or len(list_filter({TOKS.format('label')}, lambda t: length(t) >= 4 and not regexp_matches(t, '[aeiou]'))) > 0 as bad from n group by label) select label, n from g where bad""")
def q_garble_flags(spark, sf_dir):
    return labels(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(T.is_garbled(F.col("label")))


@query(f"""with {NAMES}, f as (select label, min(obs_id) as o from n group by label) select label, (row_number() over (order by o, label) - 1)::int as label_id from f""")
def q_vocab_index(spark, sf_dir):
    return T.vocabulary(labels(spark, sf_dir), "label", "obs_id")


@query(r"""select conv_id, turn, trim(regexp_extract(t, '(?i).*ANSWER:\s*(.+?)\s+CONF:\s*([0-9]*\.?[0-9]+)', 1)) as answer, greatest(0.0::double, least(1.0::double, regexp_extract(t, '(?i).*ANSWER:\s*(.+?)\s+CONF:\s*([0-9]*\.?[0-9]+)', 2)::double)) as conf
from (select conv_id, turn, 'ANSWER: none CONF: 0.1 then ANSWER: ' || role || ' ' || turn::varchar || '  CONF: ' || (conv_id % 20 / 10.0::double)::varchar as t from conversations)""")
def q_answer_parse(spark, sf_dir):
    text = F.concat(F.lit("ANSWER: none CONF: 0.1 then ANSWER: "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("  CONF: "), (F.col("conv_id") % 20 / 10.0).cast("string"))
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.parse_answer(text).alias("a")).select("conv_id", "turn", "a.*")


@query(r"""with x as (select conv_id, turn, case when turn % 3 = 0 then 'first 3' || chr(10) || 'ANSWER: ' || (conv_id % 9)::varchar || ' name' || chr(10) || 'done' when turn % 3 = 1 then 'so it is ' || (conv_id % 9)::varchar || ' or 2' else 'none at all' end as t from conversations),
n as (select conv_id, turn, case when contains(t, 'ANSWER: ') then regexp_extract(t, 'ANSWER:\s*(\d+)', 1) else regexp_extract(t, '\b(\d+)\b', 1) end as n from x) select conv_id, turn, case when n <> '' and n::int between 1 and 5 then n::int end as choice from n""")
def q_choice_parse(spark, sf_dir):
    n = (F.col("conv_id") % 9).cast("string")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("first 3\nANSWER: "), n, F.lit(" name\ndone"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("so it is "), n, F.lit(" or 2"))).otherwise("none at all")
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.parse_choice(text, 5).alias("choice"))


@query("select p_partkey as id, 1 as number, lower(p_name) as name from part union all select p_partkey, 2, 'muscle' from part")
def q_legend_parse(spark, sf_dir):
    text = F.concat(F.lit("1  "), "p_name", F.lit(" 2 Muscle. 2 again 77 beyond"))
    return X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(T.parse_legend(text)).alias("l")).select("id", "l.*")


@query("select page_id, list_sort(list_distinct(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1))) as links from pages")
def q_link_ids(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)))).alias("links"))


@query("select page_id, substring(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) as slug, length(html) > 1000 and html like '<!DOCTYPE%' as complete from pages")
def q_slugs(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"), ((F.length("html") > 1000) & F.startswith("html", F.lit("<!DOCTYPE"))).alias("complete"))


@query("select doc_id from documents where not regexp_matches(text, '(?i)copyright|all rights reserved|©')")
def q_credit_filter(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").where(~F.col("text").rlike("(?i)copyright|all rights reserved|©")).select("doc_id")


@query("with k as (select * from documents where contains(lower(text), 'token')) select doc_id from k union all select doc_id from documents where (select count(*) from k) = 0")
def q_keyword_or_all(spark, sf_dir):
    """Rows with the keyword, or all rows if none has it."""
    docs = X.table(spark, sf_dir, "documents")
    hit = F.contains(F.lower("text"), F.lit("token"))
    some = docs.agg(F.bool_or(hit).alias("some"))
    return docs.join(F.broadcast(some)).where(hit | ~F.coalesce("some", F.lit(False))).select("doc_id")


@query(f"with {NAMES}, c as (select label, count(*) as n from n group by label) select n, count(*) as labels, (n >= 2)::boolean as core from c group by n")
def q_long_tail(spark, sf_dir):
    counts = labels(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("labels")).withColumn("core", F.col("n") >= 2)


@query(f"""with {NAMES}, c as (select label, count(*) as n from n group by label), r as (select label, row_number() over (order by n desc, label) as rank, sum(n) over (order by n desc, label rows unbounded preceding) / sum(n) over () as cum from c)
select min(case when cum >= 0.5 then rank end)::int as for_half, min(case when cum >= 0.8 then rank end)::int as for_most, max(rank)::int as labels from r""")
def q_cum_coverage(spark, sf_dir):
    counts = labels(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rows = M.cumulative_coverage(counts)
    return rows.agg(F.min(F.when(F.col("cum") >= 0.5, F.col("rank"))).alias("for_half"), F.min(F.when(F.col("cum") >= 0.8, F.col("rank"))).alias("for_most"), F.max("rank").alias("labels"))


@query(f"with {NAMES}, c as (select source, count(*) as n, count(distinct label) as labels from n group by source) select source, n, labels, round(n::double / sum(n) over (), 6) as share from c")
def q_source_composition(spark, sf_dir):
    rows = labels(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query(f"with {NAMES} select count(*) as rows, sum((label <> lower(label_raw))::int)::bigint as changed, sum((label_raw like '%(cut)')::int)::bigint as states, count(distinct label) as labels, count(distinct label_raw) as raw_labels from n")
def q_change_counters(spark, sf_dir):
    return labels(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") != F.lower("label_raw")).alias("changed"), F.count_if(F.endswith("label_raw", F.lit("(cut)"))).alias("states"), F.countDistinct("label").alias("labels"), F.countDistinct("label_raw").alias("raw_labels"))


@query(f"with {NAMES}, m as (select label, source, count(*) as n from n group by all), r as (select *, row_number() over (partition by label order by n desc, source) as r from m) select label, source from r where r = 1")
def q_dominant_source(spark, sf_dir):
    return M.mode_by(labels(spark, sf_dir), "label", "source")


@query(f"""with {NAMES}, b as (select * from n where source = 'B'), a as (select label, min(obs_id) as o from n where source = 'A' group by label) select b.obs_id, case when a.label is not null then a.label else 'EXT::' || b.label end as label from b left join a using (label)""")
def q_foreign_vocabulary(spark, sf_dir):
    """Labels of one source mapped into the vocabulary of another, or into a namespace of their own."""
    rows = labels(spark, sf_dir)
    known = rows.where("source = 'A'").select("label").distinct().withColumn("_known", F.lit(True))
    return rows.where("source = 'B'").join(known, "label", "left").select("obs_id", F.when(F.col("_known"), F.col("label")).otherwise(F.concat(F.lit("EXT::"), "label")).alias("label"))


@query(f"""with {X.LABELS}, d as (select obs_id, lower(label_raw) as label from raw_labels), t as (select distinct label, unnest({TOKS.format('label')}) as token from d) select token, count(*) as df from t group by token having count(*) >= 2""")
def q_token_lexicon(spark, sf_dir):
    rows = X.raw_labels(spark, sf_dir).select(F.lower("label_raw").alias("label")).distinct()
    return rows.select(F.explode(F.array_distinct(T.tokens(F.col("label")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df >= 2")
