"""Sharding by fixed virtual slots.

A record hashes by its id into one of ``SLOTS`` virtual slots, for good. A small versioned table maps slots to
shards. It is made from the bytes in each slot, and edited - never recomputed - when shards are added or loads
drift: an edit moves whole slots. Only the map, one row a slot, comes to the driver.

Law: ``bytes`` - shard sizes are nearly equal (slots are placed heaviest first on the lightest shard).
Size of a record: UTF-8 bytes of its text (null: none) plus 16. Its position is gapless from 0 in its shard, by
virtual slot, then id, so no task ever sorts a whole shard.

Cases: a very long text is one record, and a shard that holds it may be larger than the others; rows with a null id are dealt out by their text; repeated ids and rows land together, in an order given by their text; an empty table
gives an empty result and a map of empty slots dealt round; extra columns are ignored by ``assign``.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes

SLOTS = 16_384
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def size_of(text_col: str = "text"):
    return F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 16


def virtual_slot(id_col: str = "doc_id", slots: int = SLOTS, text_col: str = "text"):
    return F.pmod(F.coalesce(F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string"))), F.xxhash64(text_col)), F.lit(slots)).cast("int")


def slot_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> dict[int, int]:
    """Bytes of each slot: partial sums in the map tasks, at most one row a slot here."""
    rows = docs.groupBy(virtual_slot(id_col, slots, text_col).alias("v")).agg(F.sum(size_of(text_col)).alias("b")).collect()
    return {r.v: r.b for r in rows}


def first_map(loads: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """Slot -> shard: heaviest slot first, each on the lightest shard; ties by number."""
    heap = [(0, 0, s) for s in range(shards)]
    out = [0] * slots
    for v in sorted(range(slots), key=lambda v: (-loads.get(v, 0), v)):
        load, n, s = heapq.heappop(heap)
        out[v] = s
        heapq.heappush(heap, (load + loads.get(v, 0), n + 1, s))
    return out


def grow(now: list[int], loads: dict[int, int], shards: int) -> list[int]:
    """Edit for one more shard: slots move only into it, from the heaviest shards, until it has its fair share."""
    out, held = list(now), np.bincount(now, [loads.get(v, 0) for v in range(len(now))], shards + 1)
    fair, by = held.sum() / (shards + 1), [[] for _ in range(shards)]
    for v in sorted(range(len(now)), key=lambda v: (loads.get(v, 0), -v)):
        by[now[v]].append(v)
    heap = [(-held[s], s) for s in range(shards)]
    heapq.heapify(heap)
    while heap and held[shards] < fair:
        _, s = heapq.heappop(heap)
        while by[s]:
            v = by[s].pop()
            b = loads.get(v, 0)
            if b and held[shards] + b <= fair * 1.001 and held[s] - b >= fair * 0.98:
                out[v] = shards
                held[s], held[shards] = held[s] - b, held[shards] + b
                heapq.heappush(heap, (-held[s], s))
                break
    return out


def rebalance(now: list[int], loads: dict[int, int], shards: int, slack: float = 0.01) -> list[int]:
    """Edit for drifted loads: move slots from shards above the mean to the lightest, as few as bring all within slack."""
    out = list(now)
    held = np.bincount(now, [loads.get(v, 0) for v in range(len(now))], shards)
    mean = held.mean()
    for s in np.argsort(-held, kind="stable").tolist():
        mine = sorted((v for v in range(len(now)) if now[v] == s), key=lambda v: (-loads.get(v, 0), v))
        for v in mine:
            to, b = int(held.argmin()), loads.get(v, 0)
            if held[s] <= mean * (1 + slack):
                break
            if b and held[to] + b < held[s]:
                out[v] = to
                held[s], held[to] = held[s] - b, held[to] + b
    return out


def map_frame(spark: SparkSession, mapping: list[int], version: int) -> DataFrame:
    return spark.createDataFrame([(version, v, s) for v, s in enumerate(mapping)], MAP_SCHEMA)


def save_map(spark: SparkSession, mapping: list[int], path: str, version: int) -> None:
    """Versions are kept side by side: an edit adds one, readers name the version they use. A version is written once: a second writer fails."""
    map_frame(spark, mapping, version).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    rows = spark.read.parquet(path)
    version = rows.agg(F.max("version")).first()[0] if version is None else version
    return [r.shard for r in rows.where(F.col("version") == version).orderBy("virtual_slot").collect()]


def edited(spark: SparkSession, path: str, version: int) -> DataFrame:
    """virtual_slot, next_shard: the map of a version, one row a slot."""
    return map_frame(spark, load_map(spark, path, version), version).select("virtual_slot", F.col("shard").alias("next_shard"))


def assign_by(docs: DataFrame, path: str, version: int | None = None, **options) -> DataFrame:
    """``assign`` with a version of the stored map, the last one by default."""
    return assign(docs, load_map(docs.sparkSession, path, version), **options)


def assign(docs: DataFrame, mapping: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per record: doc_id, size, text_crc32, virtual_slot, shard, slot (its position in the shard)."""
    slots = len(mapping)
    rows = docs.select(F.col(id_col).alias("doc_id"), size_of(text_col).alias("size"), F.crc32(as_bytes(text_col)).alias("text_crc32"), virtual_slot(id_col, slots, text_col).alias("virtual_slot"))
    placed = map_frame(docs.sparkSession, mapping, 0).select("virtual_slot", "shard")
    counts = docs.groupBy(virtual_slot(id_col, slots, text_col).alias("virtual_slot")).count()
    starts = placed.join(F.broadcast(counts), "virtual_slot").withColumn("start", F.sum("count").over(W.partitionBy("shard").orderBy("virtual_slot")) - F.col("count"))
    within = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    # one row a slot: the map's size is fixed by SLOTS, so it may be broadcast
    return rows.withColumn("within", within).join(F.broadcast(starts.drop("count")), "virtual_slot").select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("within")).alias("slot"))
