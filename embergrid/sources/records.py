"""Readers and writers of records, vocabularies, metric files and manifests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import is_written, staged

FOLDER_FILES = 1000

RECORD = "image string, q array<int>, label string, label_id int, page string, src string, w int, h int, region string, conf double, source string, label_raw string"
MANIFEST = "region string, title string, file_id string, source_url string, path string, sha256 string, bytes bigint, downloaded_at string"


def read_records(spark: SparkSession, path: str, source: str | None = None, schema: str = RECORD) -> DataFrame:
    """JSON lines (blank lines are skipped); q becomes a point. With a source tag, if given."""
    rows = spark.read.schema(schema).json(path).where(F.col("q").isNotNull() | F.col("label").isNotNull())
    rows = rows.withColumn("x", F.get("q", F.lit(0))).withColumn("y", F.get("q", F.lit(1)))
    return rows.withColumn("source", F.lit(source)) if source else rows


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Tables of different shapes under one schema, tagged by source."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def core(rows: DataFrame, label: str = "label", least: int = 2) -> DataFrame:
    """Rows whose label has at least `least` rows: counts are aggregated first, so a frequent label does not fill a window."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(label)
    return rows.join(counts, label, "left_semi")


def unmatched_vectors(vectors: DataFrame, records: DataFrame, key: str = "vec_id") -> DataFrame:
    """Vectors without a record: empty if the two tables agree."""
    return vectors.join(records.select(key), key, "left_anti")


def read_metric_files(spark: SparkSession, pattern: str) -> DataFrame:
    """One JSON file an experiment -> folder, number, raw text; sorted by number where the reader asks for it."""
    files = spark.read.option("wholetext", True).text(pattern).select(F.col("value").alias("metrics"), F.col("_metadata.file_path").alias("path"))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.select(folder.alias("folder"), F.regexp_extract(folder, r"^(\d+)", 1).cast("int").alias("number"), "metrics")


def next_number(index: DataFrame) -> DataFrame:
    return index.agg((F.coalesce(F.max("number"), F.lit(0)) + 1).alias("next"))


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order; max/min of structs, so no window holds a whole key."""
    best = F.min_by(F.struct("*"), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(best.alias("r")).select("r.*")


def new_rows(manifest: DataFrame, found: DataFrame, key: str = "file_id") -> DataFrame:
    """Found resources that the manifest does not hold yet, each once."""
    return first_per_key(found.join(manifest.select(key), key, "left_anti"), [key], found.columns)


def append_manifest(spark: SparkSession, path: str, found: DataFrame, key: str = "file_id") -> int:
    """Append what is new; a second call with the same rows appends nothing."""
    known = spark.read.parquet(path).select(key) if is_written(spark, path) else spark.createDataFrame([], found.select(key).schema)
    new = new_rows(known, found, key)
    new.write.mode("append").parquet(path)
    return new.count()


def content_row(content: str = "content"):
    """sha256 and byte size of a binary column."""
    return [F.sha2(F.col(content), 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes")]


def looks_like(content: str, magic: str, least_bytes: int):
    return (F.octet_length(content) >= least_bytes) & (F.substring(F.col(content).cast("binary"), 1, len(magic)) == F.lit(magic).cast("binary"))


def write_records(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.select("label", "label_id").write.json(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label string, label_id int").json(path)


def write_once(rows: DataFrame, path: str) -> DataFrame:
    """A sealed table: written by the first caller, read back by all others."""
    spark = rows.sparkSession
    if not is_written(spark, path):
        rows.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def answered(log: DataFrame, manifest: DataFrame, answer: str, key: str = "id") -> DataFrame:
    """Answers of a log (one JSON array in each row's `value`, entries of schema `answer`) with the manifest's row of the same key.

    Arrays that cannot be read and entries without a key have no partner; an answer given twice stays twice.
    """
    entries = log.select(F.explode(F.from_json("value", f"array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in answer.split(','))}>>")).alias("a"))
    return entries.select("a.*").join(manifest, key)


def orphans(resources: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Resources that no record refers to: reported, never deleted."""
    return resources.join(records.select(key).distinct(), key, "left_anti")


def renumber(keys: DataFrame, key: str, width: int = 5) -> DataFrame:
    """Dense numbers in sorted order, zero-padded. Counts by range first, so that no task sorts all keys."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = staged(keys.select(key).distinct().repartitionByRange(n, key).withColumn("_p", F.spark_partition_id()), "keys")
    before = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).select("_p", (F.sum("n").over(W.orderBy("_p")) - F.col("n")).alias("_b"))
    rank = F.row_number().over(W.partitionBy("_p").orderBy(key)) - 1
    return parts.withColumn("_r", rank).join(F.broadcast(before), "_p").select(key, F.lpad((F.col("_b") + F.col("_r")).cast("string"), width, "0").alias("number"))


def _write_files(batches: Iterator[pa.RecordBatch], path: str, key: str) -> Iterator[pa.RecordBatch]:
    """Files of one task, in folders of its own; another attempt of the task writes the same ones."""
    store, root = fs.FileSystem.from_uri(path)
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for value, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            folder = f"{root}/{part:05d}-{n // FOLDER_FILES:05d}"
            if n % FOLDER_FILES == 0:
                store.create_dir(folder)
            with store.open_output_stream(f"{folder}/{key}={value}-{part}-{n}") as out:
                out.write(content.as_buffer())
            n += 1
    yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])


def write_files(rows: DataFrame, path: str, key: str, content: str) -> None:
    """A file for each row, named `key`=value (and a number of its own), with the bytes of `content` and a line end; in folders of FOLDER_FILES.

    Spark's writers make a folder, a temporary file and a rename of each file; tasks write them by Arrow's file systems instead. In a store that those do not know, the text writer makes a folder for each key."""
    lines = rows.where(F.col(content).isNotNull()).select(key, F.col(content).alias("value"))
    try:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        lines.write.partitionBy(key).text(path)
        return
    body = F.concat(F.col("value").cast("binary"), F.lit("\n").cast("binary"))
    lines.select(F.col(key).cast("string"), body).mapInArrow(partial(_write_files, path=path, key=key), "n bigint").agg(F.sum("n")).collect()


def scan_files(spark: SparkSession, path: str, magic: str, least_bytes: int, pattern: str = "*") -> DataFrame:
    """path, bytes, ok: files under path of at least `least_bytes`, and whether they begin with `magic`.

    The size comes from the listing and is pushed to the source, so a shorter file is never opened; of the others nothing but the verdict is kept."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    long = files.where(F.col("length") >= least_bytes)
    return long.select("path", F.col("length").alias("bytes"), (F.substring("content", 1, len(magic.encode())) == F.lit(magic).cast("binary")).alias("ok"))


def append_metrics(rows: DataFrame, path: str) -> None:
    """experiment, method, seed, metric, value."""
    rows.select("experiment", "method", "seed", "metric", "value").write.mode("append").partitionBy("experiment").parquet(path)
