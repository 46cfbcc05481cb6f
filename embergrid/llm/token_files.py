"""Token ids in Parquet list columns.

Documents are dealt out by ranges of their id, sorted, tokenised where they land, and written as Parquet: version-2
pages (delta-packed numbers where no dictionary pays), dictionary-encoded token ids, bounded row groups, bounded pages
with a page index. So a reader of a few documents, or of the metadata columns alone, reads those pages only.

Columns: doc_id, ids, n_tokens, part (which file of the order) and start_in_part. ``digests`` adds up parts.

Cases: a text of any length is one list in one file; a null text counts as empty: its ids are the end id alone; null ids come first; repeated ids are ordered by a
hash of their text and may lie in two neighbouring parts; an empty table gives files without rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, tidy
from .tokens import TOKENIZERS, tokenizer, tokenizer_path

SCHEMA = "doc_id bigint, ids array<int>, n_tokens bigint, part int, start_in_part bigint"
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 256
END = 2


@partial(tidy, cache=TOKENIZERS)
def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int, special: bool) -> Iterator[pa.RecordBatch]:
    tok, at, part = tokenizer(path, special), 0, TaskContext.get().partitionId()
    for b in batches:
        ids, counts = tok.encode_many(b.column(1).to_pylist(), end)
        ends = np.cumsum(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
        yield pa.record_batch([b.column(0), lists, pa.array(counts), pa.array(np.full(len(counts), part, np.int32)), pa.array(at + ends - counts)], names=["doc_id", "ids", "n_tokens", "part", "start_in_part"])
        at += int(counts.sum())


def write(docs: DataFrame, target: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, path: str | None = None, parts: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS, special: bool = False) -> None:
    """Write the token files of docs to the folder target. `special`: as of ChunkTokenizer."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    rows = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "t")
    out = rows.mapInArrow(partial(_encode, path=path or tokenizer_path(), end=end, special=special), SCHEMA)
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.block.size": row_group_bytes, "parquet.page.row.count.limit": page_rows, "parquet.dictionary.page.size": 1 << 20, "compression": "zstd"}
    out.write.options(**options).parquet(target)


def read(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(target)


def documents(spark: SparkSession, target: str, ids: list[int]) -> DataFrame:
    """Token lists of chosen documents: the page index limits what is read."""
    return read(spark, target).where(F.col("doc_id").isin([int(i) for i in ids])).select("doc_id", "ids")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
        crc = [zlib.crc32(flat[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.record_batch([*b.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, target: str) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 (crc32 of the ids as little-endian unsigned 32-bit)."""
    small_batches(spark)
    files = read(spark, target)
    checked = files.select("doc_id", "part", "start_in_part", "ids").mapInArrow(_check, "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, ids_crc32 bigint")
    before = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    # one row for each part written: their number is the one that write() was given
    return checked.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
