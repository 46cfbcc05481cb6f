"""Connected components of a table of links.

Links first contract inside tasks of at most EDGES links each: a task joins its own links and passes on one link from each
node to the least node it knows. Where one task holds all links, that is the answer. Otherwise contraction repeats while it
pays, and rounds of least labels with pointer jumping, each a table in the shared folder, finish the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embergrid.sources.shared import staged

EDGES = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])


def components(links: DataFrame, edges_a_task: int = EDGES) -> DataFrame:
    """links: a, b (long). Returns node, label: the least node reachable; each linked node once."""
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    n = edges.count()
    while True:
        tasks = max(1, -(-n // edges_a_task))
        edges = staged(edges.repartition(tasks).mapInArrow(_contract, "a bigint, b bigint"), "contracted")
        if tasks == 1:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        left = edges.where("a <> b").count()
        if left > 0.7 * n:
            return _rounds(edges)
        n = left


def _rounds(links: DataFrame) -> DataFrame:
    edges = staged(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = staged(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def group_of(rows: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """rows with `block`: the least key of the component, or the row's own key."""
    found = components(links).select(F.col("node").alias(key), "label")
    return rows.join(found, key, "left").withColumn("block", F.coalesce("label", key)).drop("label")
