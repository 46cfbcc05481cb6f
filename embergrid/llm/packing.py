"""Packing by shortest-pack-first over the length histogram.

Documents become token pieces: whole sequences of ``size`` ids and a rest. The driver sees only the histogram of piece
lengths (at most ``size`` rows). Lengths are placed longest first, each on the emptiest pack that has room, a whole
group of equal packs at a time, which gives patterns (lengths side by side) with counts. Pieces of one length are
numbered over the whole table - by salted buckets and their counts, so no task holds all pieces of a length - and the
number picks pattern, sequence and offset.

Sequences are padded to ``size``, unless their length is a power of two.

Cases: a text of any length is cut into as many pieces as it needs; a null text counts as empty, and every document has its end id, so at least one piece; null or repeated ids and
repeated rows are packed each on its own (and dealt out by the task that cut them); an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, staged, tidy
from .tokens import TOKENIZERS, tokenizer, tokenizer_path

SIZE = 1024
END = 0
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PART = ", part int"  # the task that cut a piece: deals out rows that are alike
PACKED = PIECES + ", sequence_id bigint, offset bigint"


@partial(tidy, cache=TOKENIZERS)
def cut_pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int, keep_ids: bool, special: bool = False) -> Iterator[pa.RecordBatch]:
    tok, part = tokenizer(path, special), TaskContext.get().partitionId()
    for b in batches:
        ids, counts = tok.encode_many(b.column(1).to_pylist(), end)
        ids = ids.astype("<u4")
        n = -(-counts // size)
        doc = np.repeat(np.arange(len(counts)), n)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * size
        length = np.minimum(size, counts[doc] - start)
        at = (np.cumsum(counts) - counts)[doc] + start
        crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
        columns = [b.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[doc]), pa.array(np.full(len(doc), part, np.int32))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part"]
        if keep_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([at, [len(ids)]]), pa.int32()), pa.array(ids.astype(np.int32))))
            names.append("ids")
        yield pa.record_batch(columns, names=names)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, path: str | None = None, keep_ids: bool = False, special: bool = False) -> DataFrame:
    """One row per piece of at most `size` ids: doc_id, start, length, ids_crc32, doc_tokens, part and, if asked for, ids. `special`: as of ChunkTokenizer."""
    small_batches(docs.sparkSession)
    schema = PIECES + PART + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t")).mapInArrow(partial(cut_pieces, path=path or tokenizer_path(), size=size, end=end, keep_ids=keep_ids, special=special), schema)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest-pack-first: (count, lengths in order) for all lengths with their numbers."""
    room: list[list[list]] = [[] for _ in range(size + 1)]  # by what a pack has left: [count, lengths]
    for length in sorted(histogram, reverse=True):
        left, space = histogram[length], size
        while left:
            while space >= length and not room[space]:
                space -= 1
            if space < length:
                # a new pack is the emptiest until it is full: filled packs, then one for the remainder
                deep = min(size // length, left)
                room[size - deep * length].append([left // deep, (length,) * deep])
                left %= deep
                if left:
                    room[size - left * length].append([1, (length,) * left])
                    left = 0
            else:
                # a whole group at a time, as deep as its packs can take this length and the group can be filled evenly
                group = room[space].pop()
                deep = max(1, min(space // length, left // group[0]))
                used = min(group[0], left)
                if used < group[0]:
                    room[space].append([group[0] - used, group[1]])
                if deep > 1 and any(room[s] for s in range(space - (deep - 1) * length, space + 1)):
                    deep = 1  # other packs are as empty, or are the emptiest before the last round
                room[space - deep * length].append([used, group[1] + (length,) * deep])
                left -= used * deep
    return [(n, lengths) for groups in room for n, lengths in groups]


def plan(packs: list[tuple[int, tuple[int, ...]]], size: int = SIZE) -> dict[int, np.ndarray]:
    """Length -> rows (first rank, first sequence, offset), sorted by rank: the join of patterns with ranks."""
    rows: dict[int, list] = {}
    rank: dict[int, int] = {}
    first = 0
    for n, lengths in packs:
        offset = 0
        for k in lengths:
            r = rank.get(k, 0)
            rows.setdefault(k, []).append((r, first, offset))
            rank[k] = r + n
            offset += k
        first += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _place(batches: Iterator[pa.RecordBatch], by_length) -> Iterator[pa.RecordBatch]:
    for b in batches:
        length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length).tolist():
            rows, mine = by_length.value[k], np.flatnonzero(length == k)
            at = np.searchsorted(rows[:, 0], rank[mine], "right") - 1
            sequence[mine] = rows[at, 1] + rank[mine] - rows[at, 0]
            offset[mine] = rows[at, 2]
        yield pa.record_batch([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces, as of token_pieces (staged, so that each is made once), with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").count().collect()  # at most `size` rows
    by_length = spark.sparkContext.broadcast(plan(patterns({r.length: r["count"] for r in counts}, size), size))
    # rank within a length: buckets of some ten thousand pieces, and where each bucket starts
    buckets = max(16, sum(r["count"] for r in counts) // 20_000)
    rows = pieces.select(*PIECES.replace(" bigint", "").split(", "), F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "part"), F.lit(buckets)).alias("bucket"))
    starts = rows.groupBy("length", "bucket").count()
    starts = starts.select("length", "bucket", (F.sum("count").over(W.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("before"))
    within = F.row_number().over(W.partitionBy("bucket", "length").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = rows.withColumn("within", within).join(starts, ["length", "bucket"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("within")).alias("rank"))
    return ranked.mapInArrow(partial(_place, by_length=by_length), PACKED)


def pack_documents(docs: DataFrame, size: int = SIZE, end: int = END, **options) -> DataFrame:
    return pack(staged(token_pieces(docs, size=size, end=end, **options), "pieces"), size)
