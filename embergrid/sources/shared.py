"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and all runs on this machine."""
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
    """Write and read back: cuts lineage, and survives lost executors."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a job needs on its way, by name; those that nothing reads any more can be deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = stage_path(self.spark, name)
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_but_last(self, name: str) -> None:
        for path in self.paths[name][:-1]:
            delete(self.spark, path)
        del self.paths[name][:-1]


def delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a folder has data in it. Errors of the store are raised, not taken for an absent table."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(context._jsc.hadoopConfiguration())
    return store.exists(folder) and any(not x.getPath().getName().startswith(("_", ".")) for x in store.listStatus(folder))


def replace_files(spark: SparkSession, rows: DataFrame, target: str, name: str) -> None:
    """Put rows into the table at target as files that begin with `name`, in place of those that do."""
    work = f"{target.rstrip('/')}/_{name}"  # readers pass over it
    rows.write.mode("overwrite").parquet(work)
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    store = path(target).getFileSystem(context._jsc.hadoopConfiguration())
    for old in store.globStatus(path(f"{target}/{name}-*")):
        store.delete(old.getPath(), False)
    for new in store.globStatus(path(f"{work}/part-*")):
        store.rename(new.getPath(), path(f"{target}/{name}-{new.getPath().getName()}"))
    store.delete(path(work), True)
