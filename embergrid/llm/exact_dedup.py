"""Exact deduplication by two-pass Bloom filtering.

Pass 1 builds a filter of hashes met at least twice. Pass 2 tests every row against it: rows that fail are
certainly unique and pass straight through, without a shuffle; only the others meet by their full digest.

Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. Of equal texts the row with the most code
points in the original text stays, then the smallest doc_id (null ids last).

Cases: a null text counts as empty, and all empty texts are one group; a text of any length is hashed whole and is one row of a batch. Rows that repeat both text and doc_id are
one document: ``mark_copies`` marks all of them kept, ``drop_copies`` keeps one row. Empty tables give empty
results. Extra columns, whatever their names, are ignored by ``mark_copies`` and kept by ``drop_copies``.
A filter holds ``bits_per_row`` bits a row. Rows that would need more than ``max_bits`` are dealt out over ranges of their digests with a filter each.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import Staging, as_bytes, join_hot, next_pow2, small_batches

SPACE = b" \t\n\x0b\x0c\r"


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text.translate(None, SPACE)).digest()


def _hashed(text: pa.Array) -> pa.Array:
    return pa.array([digest(x) for x in text.to_pylist()], pa.binary())


def _probe(filter_):
    """Arrow function digest -> whether it may be repeated."""
    return F.arrow_udf(lambda sha: pa.array(_met(filter_.value, sha.to_pylist())), "boolean").asNondeterministic()


def _judge(repeated, keepers):
    """Arrow function (text, id, chars) -> (digest, state): 0 unique, 1 goes, 2 may stay."""

    def judge(text: pa.Array, ids: pa.Array, chars: pa.Array) -> pa.Array:
        sha = [digest(x) for x in text.to_pylist()]
        state = _met(repeated.value, sha).astype(np.int32)
        at = np.flatnonzero(state)
        keys = [hashlib.md5(f"{sha[k].hex().upper()}|{i}|{n}".encode()).digest() for k, i, n in zip(at.tolist(), ids.take(pa.array(at)).to_pylist(), chars.take(pa.array(at)).to_pylist(), strict=True)]
        state[at] += _met(keepers.value, keys)
        return pa.StructArray.from_arrays([pa.array(sha, pa.binary()), pa.array(state)], ["sha", "state"])

    return F.arrow_udf(judge, "struct<sha:binary,state:int>").asNondeterministic()


def _met(filter_: np.ndarray, keys: list[bytes]) -> np.ndarray:
    return bloom.test(filter_, bloom.pairs_of(pa.array(keys, pa.binary()))) if keys else np.zeros(0, bool)


class Copies:
    """Digests of all rows (doc_id, chars, sha, maybe) and, of texts met more than once, the best row and the number of rows.

    Texts are hashed once. Where a filter for all rows would exceed max_bits, digests are dealt out over as many ranges as bring each range's filter below it; a range is a
    folder of the digests' table, and ranges are filtered one after the other, so a filter never fills up."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, bits_per_row: int, max_bits: int):
        small_batches(docs.sparkSession)
        self.stage = Staging(docs.sparkSession)
        self.total = docs.count()
        wanted = bloom.filter_bits(self.total, bits_per_row, 1 << 62)
        ranges = next_pow2(-(-wanted // max_bits))
        # a range is told by other bytes of the digest than the places in a filter
        where = (F.conv(F.substring(F.hex("sha"), 33, 8), 16, 10).cast("long") % ranges).cast("int")
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"), F.arrow_udf(_hashed, "binary").asNondeterministic()(as_bytes(text_col)).alias("sha"))
        digests = self.stage.table(rows.withColumn("_range", where), "digests", by="_range" if ranges > 1 else None)
        parts = []
        for k in range(ranges):
            own = digests.where(F.col("_range") == k).select("doc_id", "chars", "sha")
            found = self.stage.send(bloom.build(own.select("sha"), max(wanted // ranges, 1 << 13), repeated=True))
            parts.append(self.stage.table(own.withColumn("maybe", _probe(found)("sha")), "marked"))
            self.stage.recall()
        self.rows = reduce(DataFrame.unionByName, parts)
        self.stage.drop("digests")
        self.best = self.stage.table(best_of(self.rows.where("maybe")), "best")


def best_of(rows: DataFrame) -> DataFrame:
    """sha, best_chars, keep_id, group_size of rows with sha, chars, doc_id."""
    best = rows.groupBy("sha").agg(F.max(F.struct("chars", F.bitwise_not("doc_id").alias("not_id"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return best.select("sha", F.col("best.chars").alias("best_chars"), F.bitwise_not("best.not_id").alias("keep_id"), "group_size")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    copies = Copies(docs, id_col, text_col, bits_per_row, max_bits)
    unique = copies.rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    met = join_hot(copies.rows.where("maybe"), copies.best, "sha", F.xxhash64("doc_id"), "group_size", copies.total)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("best_chars"))
    met = met.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "sha")
    return unique.unionByName(met).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """The rows that stay, with docs' own columns. Who stays is settled on digests; then two filters over the texts that are repeated - of their digests and of the
    rows to keep - pick out whose text is shuffled, and rows alike collapse in the map tasks. These filters are as large as the repeated texts ask for, up to
    max_bits; beyond, more texts are shuffled than need be."""
    copies = Copies(docs, id_col, text_col, bits_per_row, max_bits)
    texts = copies.best.where("group_size > 1")
    bits = bloom.filter_bits(texts.count(), bits_per_row, max_bits)
    repeated = docs.sparkSession.sparkContext.broadcast(bloom.build(texts.select("sha"), bits, repeated=False))
    best = best_of(copies.rows.where(_probe(repeated)("sha")))  # a unique text that this filter takes for a repeated one is its own best
    key = F.unhex(F.md5(F.concat_ws("|", F.hex("sha"), F.coalesce(F.col("keep_id").cast("string"), F.lit("None")), F.col("best_chars").cast("string"))))
    keepers = docs.sparkSession.sparkContext.broadcast(bloom.build(best.select(key), bits, repeated=False))
    chars = F.length(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), chars.alias("chars"), F.col(id_col).cast("long").alias("id"), _judge(repeated, keepers)(as_bytes(text_col), F.col(id_col).cast("long"), chars).alias("p"))
    unique = rows.where("p.state = 0").select("row.*")
    met = rows.where("p.state = 2").groupBy(F.col("p.sha").alias("sha")).agg(F.max_by("row", F.struct("chars", F.bitwise_not("id"))).alias("row"))
    return unique.unionByName(met.select("row.*"))
