"""Files written and read back, content checks and patch centres."""

from __future__ import annotations

from pyspark.sql import functions as F

from embergrid.functions import text as T
from embergrid.operators import spatial as G
from embergrid.sources import records as S
from embergrid.sources.shared import stage_path

from . import fixtures as X
from .q_text import NAMES, labels
from .registry import query

@query("select l.doc_id as id, l.quality as answer, d.lang, d.n_chars from labels l join documents d on d.doc_id = l.doc_id")
def q_answers_to_manifest(spark, sf_dir):
    """A log of JSON arrays joined to a manifest of JSON lines; both are written first, in arrays of at most 20 ids."""
    log, manifest = stage_path(spark, "answers"), stage_path(spark, "manifest")
    entries = X.table(spark, sf_dir, "labels").select(F.expr("doc_id div 20").alias("part"), F.struct(F.col("doc_id").alias("id"), F.col("quality").alias("answer")).alias("a"))
    entries.groupBy("part").agg(F.to_json(F.collect_list("a")).alias("value")).select("value").write.text(log)
    S.write_records(X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars"), manifest)
    known = spark.read.schema("id bigint, lang string, n_chars bigint").json(manifest)
    return S.answered(spark.read.text(log), known, "id bigint, answer int").select("id", "answer", "lang", "n_chars")


@query(f"with {NAMES}, f as (select label, min(obs_id) as o from n group by label), i as (select label, (row_number() over (order by o, label) - 1)::int as label_id from f) select obs_id, label_id from n join i using (label)")
def q_vocabulary_file(spark, sf_dir):
    """Labels numbered by a vocabulary that is written first and read back."""
    rows, path = labels(spark, sf_dir).select("obs_id", "label"), stage_path(spark, "vocabulary")
    S.write_vocabulary(T.vocabulary(rows, "label", "obs_id"), path)
    return rows.join(S.read_vocabulary(spark, path), "label").select("obs_id", "label_id")


@query(f"with {X.PINS} select image::varchar as image, x, y, label::varchar as label, src, w, h, 'pins' as source from pins")
def q_records_file(spark, sf_dir):
    """Records through JSON lines and back."""
    path = stage_path(spark, "records")
    rows = X.pins(spark, sf_dir).select(F.col("image").cast("string").alias("image"), F.array("x", "y").alias("q"), F.col("label").cast("string").alias("label"), "src", "w", "h")
    S.write_records(rows, path)
    return S.read_records(spark, path, "pins").select("image", "x", "y", "label", "src", "w", "h", "source")


@query("""select 'classes' as experiment, label::varchar as method, 0 as seed, 'rows' as metric, count(*)::double as value from embeddings group by label
union all select 'parity', (label % 2)::varchar, 0, 'rows', count(*)::double from embeddings group by label % 2""")
def q_metric_report(spark, sf_dir):
    """Two experiments' metrics appended to one table, then read back."""
    path = stage_path(spark, "metrics")
    rows = X.raw_vectors(spark, sf_dir)
    for name, key in (("classes", F.col("label")), ("parity", F.col("label") % 2)):
        counts = rows.groupBy(key.cast("string").alias("method")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        S.append_metrics(counts.select(F.lit(name).alias("experiment"), "method", F.lit(0).alias("seed"), F.lit("rows").alias("metric"), "value"), path)
    return spark.read.parquet(path).select("experiment", "method", "seed", "metric", "value")


@query("select page_id, strlen(html) >= 500 and starts_with(html, '<') as page, strlen(html) >= 500 and starts_with(html, '%PDF') as pdf from pages")
def q_content_check(spark, sf_dir):
    """Least size and first bytes of each page."""
    return X.table(spark, sf_dir, "pages").select("page_id", S.looks_like("html", "<", 500).alias("page"), S.looks_like("html", "%PDF", 500).alias("pdf"))


@query("select page_id, (strlen(html) + case when page_id % 3 = 0 then 6 else 1 end)::bigint as bytes, page_id % 3 = 0 as ok from pages where strlen(html) + case when page_id % 3 = 0 then 6 else 1 end >= 2000")
def q_file_scan(spark, sf_dir):
    """Each page as a file of its own, every third one as a PDF by its first bytes; then the folder is scanned by size and first bytes."""
    folder = stage_path(spark, "pages")
    body = F.concat(F.when(F.col("page_id") % 3 == 0, "%PDF-").otherwise(""), F.col("html"))
    S.write_files(X.table(spark, sf_dir, "pages").select("page_id", body.alias("value")), folder, "page_id", "value")
    found = S.scan_files(spark, folder, "%PDF", 2000)
    return found.select(F.regexp_extract("path", "page_id=(-?[0-9]+)", 1).cast("long").alias("page_id"), "bytes", "ok")


@query(f"with {X.PINS}, i as (select distinct image from pins) select image, (k // 4)::int as r, (k % 4)::int as c, (k % 4 + 0.5::double) * 14 as cx, (k // 4 + 0.5::double) * 14 as cy from i, range(16) t(k)")
def q_patch_centres(spark, sf_dir):
    return X.pins(spark, sf_dir).select("image").distinct().select("image", F.inline(G.patch_centres(4, 14)))
