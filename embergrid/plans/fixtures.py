"""Views over the given tables that stand in for curated records, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.functions import vectors as V

DIMS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.col("label").cast("long").alias("label"), F.floor(F.col("vec_id") / 5).cast("long").alias("unit"), F.col("embedding").cast("array<double>").alias("e"))


def signal_vectors(spark: SparkSession, sf_dir: str, strength: float = 0.15) -> DataFrame:
    """Vectors with class signal, unit length."""
    rows = raw_vectors(spark, sf_dir)
    return rows.withColumn("e", V.unit(F.transform("e", lambda x, i: x + F.when(i % 10 == F.col("label"), strength).otherwise(0.0))))


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        i.alias("obs_id"), F.floor(i / 3).cast("long").alias("image"), F.floor(i / 15).cast("long").alias("page"), F.concat(F.lit("src"), F.floor(i / 75).cast("string")).alias("src"), F.col("label").cast("long").alias("label"),
        ((i * 37) % 660 - 10).cast("int").alias("x"), ((i * 53) % 500 - 10).cast("int").alias("y"), F.lit(640).alias("w"), F.lit(480).alias("h"),
    )


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_name")
    forms = [F.concat(F.upper(n), F.lit(" m.")), F.concat(n, F.lit(" (cut)")), F.concat(n, F.lit(" cut")), F.concat(n, F.lit(" muscles")), F.concat(F.replace(n, F.lit("o"), F.lit("0")), F.lit(" muscle")), F.concat(F.expr("substring(p_name, 1, length(p_name) - 1)"), F.lit(" muscle")), F.concat(n, F.lit(" n.")), F.concat(n, F.lit(" muscle"))]
    text = forms[7]
    for j in range(7):
        text = F.when(k % 8 == j, forms[j]).otherwise(text)
    return table(spark, sf_dir, "part").select(k.cast("long").alias("obs_id"), text.alias("label_raw"), F.when(k % 3 == 0, "A").otherwise("B").alias("source"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8 x 8 map of one value a cell."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "v"))
    return rows.select("image", F.expr("i div 8").cast("int").alias("r"), (F.col("i") % 8).cast("int").alias("c"), F.col("v").cast("double").alias("v"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label map of the grid: background 0, else the quadrant."""
    g = grid(spark, sf_dir)
    return g.withColumn("lab", F.when(F.col("v") > 0.12, 0).otherwise(1 + 2 * F.expr("r div 4") + F.expr("c div 4")).cast("int"))


RAW = "v as (select vec_id, label::bigint as label, (vec_id // 5)::bigint as unit, list_transform(embedding, lambda x: x::double) as e from embeddings)"
SIGNAL = """v0 as (select vec_id, label::bigint as label, (vec_id // 5)::bigint as unit, list_transform(range(64), lambda i: embedding[i + 1]::double + case when i % 10 = label then 0.15 else 0.0 end) as e from embeddings),
v1 as (select *, sqrt(list_dot_product(e, e)) + 1e-9 as len from v0),
v as (select vec_id, label, unit, list_transform(e, lambda x: x / len) as e from v1)"""
PINS = "pins as (select vec_id as obs_id, (vec_id // 3)::bigint as image, (vec_id // 15)::bigint as page, 'src' || (vec_id // 75)::varchar as src, label::bigint as label, ((vec_id * 37) % 660 - 10)::int as x, ((vec_id * 53) % 500 - 10)::int as y, 640 as w, 480 as h from embeddings)"
LABELS = """raw_labels as (select p_partkey as obs_id, case (p_partkey % 8)::int when 0 then upper(p_name) || ' m.' when 1 then p_name || ' (cut)' when 2 then p_name || ' cut' when 3 then p_name || ' muscles'
  when 4 then replace(p_name, 'o', '0') || ' muscle' when 5 then substring(p_name, 1, length(p_name) - 1) || ' muscle' when 6 then p_name || ' n.' else p_name || ' muscle' end as label_raw, case when p_partkey % 3 = 0 then 'A' else 'B' end as source from part)"""
GRID = "grid as (select vec_id as image, (i // 8)::int as r, (i % 8)::int as c, embedding[i + 1]::double as v from embeddings, range(64) t(i))"
REGIONS = GRID + ", cells as (select *, (case when v > 0.12 then 0 else 1 + 2 * (r // 4) + (c // 4) end)::int as lab from grid)"


def split_sql(seeds: int, fraction: float = 0.3, unit: str = "unit", source: str = "v") -> str:
    return f"""units as (select distinct {unit} as unit from {source}),
ranks as (select seed::int as seed, unit, row_number() over (partition by seed order by md5(seed::varchar || '|' || unit::varchar), unit) as rk, count(*) over (partition by seed) as n from units, range({seeds}) s(seed)),
split as (select seed, unit, rk, n, rk <= greatest(1, round_even(n * {fraction}::double, 0)) as is_test from ranks)"""


def scores_sql(seeds: int) -> str:
    """sc: seed, q, truth, label with all class statistics of test rows against train rows."""
    return f"""{split_sql(seeds)},
sims as (select a.seed, q.vec_id as q, q.label as truth, g.vec_id as g, g.label as label, list_dot_product(q.e, g.e) as sim
  from split a join v q on q.unit = a.unit and a.is_test join split b on b.seed = a.seed and not b.is_test join v g on g.unit = b.unit),
sc as (select seed, q, truth, label, max(sim) as best, sum(sim) as total, count(*) as n, sum(exp(sim / 0.1)) as soft, sum(exp((sim - 1) / (0.3 * 0.3))) as kernel from sims group by all)"""
