"""Ingest by keyed state: restarts, retries, and what a batch reads."""

import shutil

from embergrid.sources import shared
from embergrid.streaming import streams


def add(spark, folder, rows):
    spark.createDataFrame(rows, "file_id string, n int").coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path):
    stream = spark.readStream.schema("file_id string, n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def rows(spark, tmp_path):
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_restart_goes_on_and_earlier_rows_count(spark, tmp_path):
    add(spark, str(tmp_path / "out"), [("old", 0)])
    add(spark, str(tmp_path / "in"), [("old", 1), ("a", 1), ("a", 1)])
    run(spark, tmp_path)
    assert rows(spark, tmp_path) == [("a", 1), ("old", 0)]
    add(spark, str(tmp_path / "in"), [("a", 2), ("b", 2), ("old", 2)])
    run(spark, tmp_path)
    assert rows(spark, tmp_path) == [("a", 1), ("b", 2), ("old", 0)]


def test_a_batch_does_not_read_the_target(spark, tmp_path):
    add(spark, str(tmp_path / "in"), [(str(i), 1) for i in range(50)])
    run(spark, tmp_path)
    shutil.move(str(tmp_path / "out"), str(tmp_path / "away"))
    add(spark, str(tmp_path / "in"), [("7", 2), ("new", 2)])
    progress = run(spark, tmp_path).lastProgress
    assert rows(spark, tmp_path) == [("new", 2)]  # 7 is known without the table that holds it
    assert progress.numInputRows == 2 and progress.stateOperators[0].numRowsTotal == 51


def test_a_batch_tried_again_replaces_its_files(spark, tmp_path):
    target = str(tmp_path / "t")
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "file_id string").coalesce(1)
    shared.replace_files(spark, frame("ab"), target, "batch-1")
    shared.replace_files(spark, frame("c"), target, "batch-2")
    shared.replace_files(spark, frame("ab"), target, "batch-1")
    assert sorted(r.file_id for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]
