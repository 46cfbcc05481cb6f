"""Streaming entry points; each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embergrid.operators import calibration as C
from embergrid.operators import retrieval as R
from embergrid.sources.shared import is_written, replace_files


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str = "file_id"):
    """Append rows whose key the target has not seen.

    Keys are state of the stream, looked up one by one (for many keys give the session the RocksDB state store), so a micro-batch reads its own keys and not
    those of the target. Keys that the target had before the stream's first start are written once beside the checkpoint, and each batch is joined with that fixed
    table. A batch's files have its number in their names: a batch that is tried again replaces what it wrote, so nothing doubles."""
    spark = stream.sparkSession
    seen = f"{checkpoint.rstrip('/')}-seen"
    if not is_written(spark, checkpoint) and is_written(spark, target) and not is_written(spark, seen):
        spark.read.parquet(target).select(key).distinct().write.parquet(seen)

    def one(batch: DataFrame, number: int) -> None:
        session: SparkSession = batch.sparkSession
        new = batch.join(session.read.parquet(seen), key, "left_anti") if is_written(session, seen) else batch
        replace_files(session, new, target, f"batch-{number:08d}")

    return stream.dropDuplicates([key]).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def answer(queries: DataFrame, gallery: DataFrame, scale: float = 15.0) -> DataFrame:
    """Decision for each query against a fixed gallery: pred, prob, entropy_bits, abstain, topk."""
    scores = R.class_scores(queries.withColumn("mask", F.lit(1)), gallery.withColumn("mask", F.lit(1)), stats=("best",))
    return C.decide(C.softmax(R.exemplar(scores), scale))


def answer_stream(stream: DataFrame, gallery: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Ranking needs windows over a query's labels, so each micro-batch is scored as a table."""
    return stream.writeStream.foreachBatch(lambda batch, i: sink(answer(batch, gallery), i)).option("checkpointLocation", checkpoint)


def running_accuracy(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """ts, category, correct -> per window and category: n, accuracy. On a stream rows later than `delay` are dropped; a batch drops none."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "category").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy")).select(F.col("w.start").alias("day"), "category", "n", "accuracy")
