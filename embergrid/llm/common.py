"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
HOT_ROWS = 4096
HOT_KEYS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). A temporary one only where it is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="embergrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Staging:
    """Tables and broadcasts that a job needs on its way; each is given back once what follows from it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.sent = spark, {}, []

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write and read back; `by`: the last column, of few values, each a folder."""
        path = stage_path(self.spark, name)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def send(self, value):
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def recall(self) -> None:
        """Destroy the broadcasts: their readers' results are written."""
        while self.sent:
            self.sent.pop().destroy()

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        context = self.spark.sparkContext
        for name in names:
            for path in self.paths.pop(name, []):
                folder = context._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def join_hot(rows: DataFrame, one_a_key: DataFrame, key: str, spread: Column, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row for each key, which has the key's number of rows in column `count`.

    Keys of more than HOT_ROWS rows and a thousandth of `total` - fewer than a thousand, whatever the input - are dealt out
    over salts, with a copy of their one row for each."""
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = [(r[0], -(-r[1] // least)) for r in one_a_key.where(F.col(count) > least).select(key, count).collect()]
    if not hot:
        return rows.join(one_a_key, key, how)
    salts = F.broadcast(rows.sparkSession.createDataFrame(hot, f"`{key}` {dict(one_a_key.dtypes)[key]}, _salts bigint"))
    many = F.coalesce("_salts", F.lit(1))
    left = rows.join(salts, key, "left").withColumn("_salt", F.pmod(spread, many)).drop("_salts")
    right = one_a_key.join(salts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


#: What Python workers remember from task to task, by operator.
CACHES: list[dict] = []


def tidy(task, cache: dict | None = None):
    """A function of batches for mapInArrow that drops other operators' caches first, and gives free memory back at its end:
    workers are used again, and else hold what all operators before needed."""

    @wraps(task)
    def run(*args, **options):
        for c in CACHES:
            if c is not cache:
                c.clear()
        try:
            yield from task(*args, **options)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows and bytes of an Arrow batch, so that long texts do not pile up in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def as_bytes(column: str = "text"):
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def single_thread() -> None:
    """Libraries inside a task use the task's core only."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def next_pow2(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()
