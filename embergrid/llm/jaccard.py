"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Texts become sets of hashed five-word shingles. Texts with equal sets are one class, which is what is joined.
2. Shingles are ordered rare first, by a count sketch over all documents (bucket count, then hash). Two sets of Jaccard
   t or more share a shingle among the first n - ceil(t n) + 1 of each. These prefixes meet by shingle. A shingle that the
   sketch has counted once is in no other set and stays at home.
3. Pairs must pass the length filter, the positional filter (what can still follow the shared shingle) and the suffix
   filter: both sets are split into 1,024 parts by hash, and the parts whose sizes differ in parity bound the symmetric difference from below.
4. Each pair left is verified once, by the exact overlap. Pairs are verified component by component of their graph, so a
   set is sent once for all its pairs; components too large for one task are dealt out by their first ends.

``similar_pairs`` verifies every candidate pair of classes. ``components`` needs no pair whose ends are already known to be
connected: first every list is linked through its least class and between neighbours, then only candidates across
different components that were not refused before are verified. So large groups of near copies do not make all their pairs, and no link
is lost. Lists of a shingle counted more than LIST times are dealt out over salts; their first classes link the salts.

The sketch is sized by the texts' bytes up to MAX_BUCKETS counters of one byte. Beyond that rare shingles look alike, more of them travel
to meet nobody, and the result is the same.

Cases: null and empty texts have no shingles and link with nothing; very long texts have all their shingles, whatever their number; equal texts are linked; a null doc_id takes part in
classes, but the smallest id ignores it; repeated rows are rows of one class; rows that share an id are told apart by their texts; empty
tables give empty results; extra columns, whatever their names, are ignored by ``components`` and kept by ``drop_near_copies``.
Of a component, ``drop_near_copies`` keeps the rows of the smallest id (null last), and of its texts those of one set. Sets are
compared by 64-bit hashes of words and shingles.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from embergrid.operators.components import components as linked

from . import bloom, sparse
from .common import Staging, as_bytes, free_name, join_hot, small_batches, tidy
from .shingles import mix, shingle_sets

THRESHOLD = 75  # of 100
SEGMENT = 16  # bits of a bucket within a segment of the sketch
MAX_BUCKETS = 1 << 25
BYTES_A_BUCKET = 32
LIST = 1024  # rows of a list for one salt
FEW_NODES = 200_000  # 16 bytes each: so many may be broadcast
GROUP_SHINGLES = 100_000  # of a component that one task verifies as a whole
SIGNED = np.int64
WORDS = 16  # of 64 parity bits each
PARITY = [f"s{k}" for k in range(WORDS)]


def class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def ceil_share(n, threshold: int):
    return -(-threshold * n // 100)


def parities(shingles: np.ndarray) -> bytes:
    """For 1,024 parts of the hash space (other bits than the sketch's): whether the set has an odd number in it."""
    part = (shingles & np.uint64(64 * WORDS - 1)).astype(np.int64)
    return np.packbits((np.bincount(part, minlength=64 * WORDS) & 1).astype(np.uint8)).tobytes()


def bucket_of(shingles: np.ndarray, buckets: int) -> np.ndarray:
    """From the upper 32 bits, for any number of buckets."""
    return ((shingles >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


# -- pass 1: classes, and how often shingles occur


@tidy
def _classes(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(buckets, np.uint8)
    names = ["doc_id", "n", "cls", "segment", "at", "counts"]
    for b in batches:
        n, cls, batch = [], [], []
        for s in shingle_sets(b.column(1).to_pylist(), width):
            n.append(len(s))
            cls.append(class_of(s))
            batch.append(s)
        if batch:
            at, k = np.unique(bucket_of(np.concatenate(batch), buckets), return_counts=True)
            counts[at] = np.minimum(counts[at] + k, 255)
        yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.binary())], names=names)
    rows = []
    for k in range(-(-buckets >> SEGMENT)):
        part = counts[k << SEGMENT : (k + 1) << SEGMENT]
        at = np.flatnonzero(part)
        if len(at):
            rows.append((k, sparse.pack(at), zlib.compress(part[at].tobytes(), 1)))
        if rows and (len(rows) == 64 or k == (buckets - 1) >> SEGMENT):
            yield pa.record_batch([*(pa.nulls(len(rows), pa.int64()) for _ in range(3)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True))], names=names)
            rows = []
    if rows:
        yield pa.record_batch([*(pa.nulls(len(rows), pa.int64()) for _ in range(3)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True))], names=names)


def level(count: np.ndarray) -> np.ndarray:
    """Counts in one byte: as they are to 128, above in eighths of a doubling."""
    return np.where(count <= 128, count, np.minimum(128 + 8 * np.log2(np.maximum(count, 128) / 128), 255)).astype(np.uint8)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The least count of a level."""
    x = levels.astype(np.float64)
    return np.where(x <= 128, x, 128 * 2 ** ((x - 128) / 8))


def _sum_counts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by segment: one array is held at a time."""
    now, total = None, None

    def out():
        return pa.record_batch([pa.array([now], pa.int32()), pa.array([zlib.compress(level(total).tobytes(), 1)], pa.binary())], names=["segment", "counts"])

    for b in batches:
        for k, at, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if k != now:
                if now is not None:
                    yield out()
                now, total = k, np.zeros(size, np.int64)
            total[sparse.unpack(at)] += np.frombuffer(zlib.decompress(c), np.uint8)
    if now is not None:
        yield out()


def sketch_of(rows: DataFrame, buckets: int) -> np.ndarray:
    """Levels of all buckets: one byte each, at most MAX_BUCKETS. A task's own count stops at 255 a bucket: such shingles are among the last in any case."""
    size, segments = min(buckets, 1 << SEGMENT), max(1, buckets >> SEGMENT)
    parts = rows.where(F.col("segment").isNotNull()).select("segment", "at", "counts")
    whole = parts.repartition(min(segments, 256), "segment").sortWithinPartitions("segment").mapInArrow(partial(_sum_counts, size=size), "segment int, counts binary")
    out = np.zeros(buckets, np.uint8)
    for k, c in whole.collect():
        out[k * size : (k + 1) * size] = np.frombuffer(zlib.decompress(c), np.uint8)
    return out


# -- pass 2: prefixes of the classes' representatives


def id_key(doc_id: int) -> bytes:
    return hashlib.md5(str(doc_id).encode()).digest()


def ids_filter(ids: DataFrame, rows: int) -> np.ndarray:
    """Bloom filter of the column doc_id."""
    return bloom.build(ids.select(F.unhex(F.md5(F.col("doc_id").cast("string"))).alias("k")).where(F.col("k").isNotNull()), bloom.filter_bits(rows, 16, 1 << 30), repeated=False)


def _wanted(filter_: np.ndarray, ids: pa.Array) -> np.ndarray:
    keys = [b"\0" * 16 if i is None else id_key(i) for i in ids.to_pylist()]
    return bloom.test(filter_, bloom.pairs_of(pa.array(keys, pa.binary()))) | np.array([i is None for i in ids.to_pylist()], bool)


def _once(batches: Iterator[pa.RecordBatch], width: int, wanted) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Batch by batch: class and shingles of the wanted documents, each class once in a task."""
    met: set[int] = set()
    for b in batches:
        out = []
        if b.num_rows:
            b = b.filter(pa.array(_wanted(wanted.value, b.column(0))))
            for s in shingle_sets(b.column(1).to_pylist(), width):
                if len(s) and (c := class_of(s)) not in met:
                    met.add(c)
                    out.append((c, s))
        yield out


@tidy
def _prefixes(batches: Iterator[pa.RecordBatch], width: int, threshold: int, list_rows: int, sketch, wanted) -> Iterator[pa.RecordBatch]:
    levels = sketch.value
    names = ["gram", "salt", "salts", "cls", "n", "pos"]
    for sets in _once(batches, width, wanted):
        gram, salts, cls, size, pos, long = [], [], [], [], [], []
        for c, s in sets:
            own = levels[bucket_of(s, len(levels))]
            met = np.flatnonzero(own > 1)
            alone = len(s) - len(met)  # they come first in the order
            p = len(s) - ceil_share(len(s), threshold) + 1 - alone
            if p > 0:
                key = (own[met].astype(np.uint64) << np.uint64(56)) | (s[met] >> np.uint64(8))
                first = met[np.argsort(key, kind="stable")[:p]]
                gram.append(s[first])
                salts.append(own[first])
                cls.append(c)
                size.append(len(s))
                pos.append(np.arange(alone, alone + len(first)))
                long.append(len(first))
        if gram:
            many = np.ceil(count_of(np.concatenate(salts)) / list_rows).astype(np.int64)
            owner = np.repeat(np.array(cls, SIGNED), long)
            salt = (mix(owner.view(np.uint64)) % many.astype(np.uint64)).astype(np.int32)
            yield pa.record_batch([pa.array(np.concatenate(gram).view(SIGNED)), pa.array(salt), pa.array(many.astype(np.int32)), pa.array(owner), pa.array(np.repeat(np.array(size, np.int32), long)), pa.array(np.concatenate(pos).astype(np.int32))], names=names)


@tidy
def _signs(batches: Iterator[pa.RecordBatch], width: int, wanted) -> Iterator[pa.RecordBatch]:
    for sets in _once(batches, width, wanted):
        signs = np.frombuffer(b"".join(parities(s) for _, s in sets), SIGNED).reshape(-1, WORDS)
        yield pa.record_batch([pa.array([c for c, _ in sets], pa.int64()), *(pa.array(signs[:, k]) for k in range(WORDS))], names=["cls", *PARITY])


@tidy
def _sets(batches: Iterator[pa.RecordBatch], width: int, wanted) -> Iterator[pa.RecordBatch]:
    for sets in _once(batches, width, wanted):
        yield pa.record_batch([pa.array([c for c, _ in sets], pa.int64()), pa.array([len(s) for _, s in sets], pa.int64()), pa.array([s.tobytes() for _, s in sets], pa.binary())], names=["cls", "n", "grams"])


# -- verification


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


@tidy
def _verify(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Sorted by group, then b: rows without b bring sets of the group; pairs come with b's set, or both sets are there."""
    now, held = None, {}
    for batch in batches:
        out = []
        for group, salt, a, b, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (group, salt) != now:
                now, held = (group, salt), {}
            if b is None:
                held[a] = np.frombuffer(grams, np.uint64)
                continue
            x, y = held[a], held[b] if grams is None else np.frombuffer(grams, np.uint64)
            o = overlap(x, y)
            if 100 * o >= threshold * (len(x) + len(y) - o):
                out.append((a, b, o))
        yield pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["a", "b", "overlap"])


# -- candidates


def can_reach(x: str, y: str, threshold: int) -> Column:
    """Length and positional filter on columns n and pos with suffixes x and y."""
    n, pos, m, at = (F.col(c) for c in (f"n{x}", f"pos{x}", f"n{y}", f"pos{y}"))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * threshold) & (F.least(n - pos, m - at) >= needed(n, m, threshold))


def needed(n: Column, m: Column, threshold: int) -> Column:
    """The least overlap of sets of n and m."""
    return F.ceil((n + m) * threshold / F.lit(100 + threshold) - 1e-9)


class Join:
    """What the steps share: digests (doc_id, n, cls), lists (gram, salt, salts, cls, n, pos) and parities of the classes in lists."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = THRESHOLD, max_buckets: int = MAX_BUCKETS, list_rows: int = LIST, group_shingles: int = GROUP_SHINGLES):
        small_batches(docs.sparkSession)
        self.threshold, self.group_shingles, self.stage = threshold, group_shingles, Staging(docs.sparkSession)
        table, send = self.stage.table, self.stage.send
        self.texts, self.width = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t")), width
        self.rows, long = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()
        buckets = min((1 + (long or 0) // BYTES_A_BUCKET >> SEGMENT) + 1 << SEGMENT, max_buckets)
        first = table(self.texts.mapInArrow(partial(_classes, width=width, buckets=buckets), "doc_id bigint, n bigint, cls bigint, segment int, at binary, counts binary"), "classes")
        self.digests = first.where(F.col("segment").isNull()).select("doc_id", "n", "cls")
        self.least = self.digests.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
        sketch, chosen = send(sketch_of(first, buckets)), send(ids_filter(self.least, self.rows))
        prefixes = self.texts.mapInArrow(partial(_prefixes, width=width, threshold=threshold, list_rows=list_rows, sketch=sketch, wanted=chosen), "gram bigint, salt int, salts int, cls bigint, n int, pos int")
        shared = prefixes.withColumn("k", F.count(F.lit(1)).over(W.partitionBy("gram", "salt")))
        shared = table(shared.where("k > 1 or salts > 1").drop("k"), "shared")
        self.stage.recall()
        # lists with the same members make the same pairs: the one whose shingle is rarest stands for all
        member = F.xxhash64("cls")
        lists = shared.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.sum(member % (1 << 40)).alias("sum"), F.bit_xor(member).alias("xor"), F.min("pos").alias("p"), F.max("salts").alias("salts")).where("k > 1")
        stay = lists.groupBy("k", "sum", "xor").agg(F.min(F.struct("p", "gram", "salts")).alias("g")).select("g.gram", F.explode(F.sequence(F.lit(0), F.col("g.salts") - 1)).alias("salt"))
        self.lists = table(shared.join(stay, ["gram", "salt"], "left_semi"), "lists")
        self.stage.drop("shared")
        signs = self._again(self.lists.select("cls").distinct(), _signs, "cls bigint, " + ", ".join(f"{x} bigint" for x in PARITY), "signs")
        self.signs = signs.dropDuplicates(["cls"])

    def _again(self, classes: DataFrame, reader, schema: str, name: str) -> DataFrame:
        """Read the texts of one document of each class again. A Bloom filter of ids picks them out, so a few others come along."""
        chosen = self.stage.send(ids_filter(classes.join(self.least, "cls").select("doc_id"), self.rows))
        out = self.stage.table(self.texts.mapInArrow(partial(reader, width=self.width, wanted=chosen), schema), name)
        self.stage.recall()
        return out

    def _suffix(self, x: str, y: str, n: Column) -> Column:
        """Suffix filter; n: of both sets."""
        differ = sum((F.bit_count(F.col(f"{s}{x}").bitwiseXOR(F.col(f"{s}{y}"))) for s in PARITY), F.lit(0))
        return differ <= n - 2 * needed(n, F.lit(0), self.threshold)

    def pairs(self, rows: DataFrame, across: bool = False) -> DataFrame:
        """Distinct candidates a < b of the lists; across: only between different labels, for which rows have a label and
        `most`, the most frequent one of the list. Of a pair across one end at least has another, and is sent to all salts."""
        rows = rows.join(self.signs, "cls")
        named = lambda side: [F.col(c).alias(c + side) for c in ("cls", "n", "pos", *PARITY, *(["label"] if across else []))]
        a = rows.where("label <> most") if across else rows
        a = a.select("gram", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *named("_a"))
        b = rows.select("gram", "salt", *named("_b"), *(["most"] if across else []))
        met = can_reach("_a", "_b", self.threshold) & self._suffix("_a", "_b", F.col("n_a") + F.col("n_b"))
        ordered = F.col("cls_a") < F.col("cls_b")
        met &= (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("most")) | ordered) if across else ordered
        return a.join(b, ["gram", "salt"]).where(met).select(*self._ordered()).distinct()

    @staticmethod
    def _ordered() -> list[Column]:
        return [F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"), (F.col("n_a") + F.col("n_b")).alias("n")]

    def _neighbours(self, rows: DataFrame, keys: list[str], steps: int) -> DataFrame:
        """Each row with the first one of its list and those up to `steps` before it, in the order of classes."""
        w = W.partitionBy(*keys).orderBy("cls")
        row = F.struct("cls", "n", "pos")
        near = rows.select(*(F.col(c).alias(f"{c}_b") for c in ("cls", "n", "pos")), F.array_distinct(F.array(F.first(row).over(w), *(F.lag(row, k).over(w) for k in range(1, steps + 1)))).alias("near"))
        near = near.select("cls_b", "n_b", "pos_b", F.explode("near").alias("o")).where("o is not null")
        near = near.select("*", *(F.col(f"o.{c}").alias(f"{c}_a") for c in ("cls", "n", "pos")))
        return near.where((F.col("cls_a") != F.col("cls_b")) & can_reach("_a", "_b", self.threshold)).select(*self._ordered())

    def first_pairs(self, steps: int = 3) -> DataFrame:
        """Each list through its least class and between near neighbours; the least classes of a list's salts likewise."""
        heads = self.lists.where("salts > 1").groupBy("gram", "salt").agg(F.min(F.struct("cls", "n", "pos")).alias("h")).select("gram", "h.*")
        return self._neighbours(self.lists, ["gram", "salt"], steps).unionByName(self._neighbours(heads, ["gram"], steps)).distinct()

    def verified(self, pairs: DataFrame, filtered: bool = False) -> DataFrame:
        """pairs: a, b, n (of both sets). Those that are links: a, b, overlap. filtered: they have passed the suffix filter."""
        table = self.stage.table
        if not filtered:
            side = lambda x: self.signs.select(F.col("cls").alias(x), *(F.col(s).alias(s + x) for s in PARITY))
            pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(self._suffix("a", "b", F.col("n")))
        left = table(pairs.select("a", "b"), "candidates")
        known = linked(left)
        sets = self._again(known.select(F.col("node").alias("cls")), _sets, "cls bigint, n bigint, grams binary", "sets")
        # components of candidates that one task can hold: each set goes there once
        nodes = known.join(sets.select(F.col("cls").alias("node"), "n").dropDuplicates(["node"]), "node")
        small = nodes.groupBy("label").agg(F.sum("n").alias("n")).where(F.col("n") <= self.group_shingles)
        nodes = table(nodes.select("node", "label").join(small.select("label"), "label").select(F.col("node").alias("cls"), "label"), "nodes")
        if nodes.count() <= FEW_NODES:
            nodes = F.broadcast(nodes)
        salt0, nothing = F.lit(-1).alias("salt"), F.lit(None).cast("binary").alias("grams")
        rows = sets.join(nodes, "cls").select(F.col("label").alias("group"), salt0, F.col("cls").alias("a"), F.lit(None).cast("long").alias("b"), "grams")
        left = left.join(nodes.withColumnRenamed("cls", "a"), "a", "left")
        rows = rows.unionByName(left.where("label is not null").select(F.col("label").alias("group"), salt0, "a", "b", nothing))
        # the others: a's set once for each salt, and b's with its pair
        rest = table(left.where("label is null").select("a", "b"), "rest")
        if not rest.isEmpty():
            many = rest.groupBy("a").agg((F.count(F.lit(1)) / 256).cast("int").alias("many"))
            rest = rest.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), "many")).cast("int").alias("salt"))
            pair = rest.join(sets.select(F.col("cls").alias("b"), "grams"), "b").select(F.col("a").alias("group"), "salt", "a", "b", "grams")
            heads = rest.select("a", "salt").distinct().join(sets.select(F.col("cls").alias("a"), "grams"), "a").select(F.col("a").alias("group"), "salt", "a", F.lit(None).cast("long").alias("b"), "grams")
            rows = rows.unionByName(heads).unionByName(pair)
        n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "group", "salt").sortWithinPartitions("group", "salt", F.col("b").asc_nulls_first())
        links = rows.mapInArrow(partial(_verify, threshold=self.threshold), "a bigint, b bigint, overlap bigint")
        links = table(links.distinct(), "links")  # a set that came along twice has met its partner twice
        self.stage.drop("candidates", "sets", "nodes", "rest")
        return links

    def labels(self) -> DataFrame:
        """node (a class), label: the classes that links connect."""
        table = self.stage.table
        first = table(self.first_pairs(), "pairs")
        links = self.verified(first)
        labels = linked(links)
        rows = self.lists.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        mixed = rows.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("k"), F.max("salts").alias("salts")).groupBy("gram").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.count(F.lit(1)).alias("labels"), F.max("salts").alias("salts"))
        mixed = mixed.where("labels > 1").select("gram", "most", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        rows = table(rows.join(mixed, ["gram", "salt"]), "mixed")
        more = table(self.pairs(rows, across=True).join(first, ["a", "b"], "left_anti"), "more")
        if not more.isEmpty():
            more = self.verified(more, filtered=True)
            if not more.isEmpty():
                labels = linked(links.select("a", "b").unionByName(more.select("a", "b")))
        self.stage.drop("mixed", "pairs", "more")
        return labels

    def close(self) -> None:
        """Delete what only the search for pairs needed."""
        self.stage.drop("lists", "signs", "links")


def similar_pairs(docs: DataFrame, **options) -> DataFrame:
    """All pairs of linked classes by their smallest doc_id: doc_a, doc_b, overlap; copies of a text are one class."""
    join = Join(docs, **options)
    links = join.verified(join.pairs(join.lists), filtered=True)
    join.stage.drop("lists", "signs")
    named = links.join(join.least.select(F.col("cls").alias("a"), F.col("doc_id").alias("x")), "a").join(join.least.select(F.col("cls").alias("b"), F.col("doc_id").alias("y")), "b")
    return named.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "overlap")


def named_classes(join: Join) -> DataFrame:
    """Per class: cls, copies, class_id (its smallest doc_id), component_id, and stays (whether it is the one that stays)."""
    labels = join.stage.table(join.labels(), "labels")
    join.close()
    named = join.least.withColumnRenamed("doc_id", "class_id").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    whole = named.groupBy("label").agg(F.min("class_id").alias("component_id"), F.min(F.struct(F.col("class_id").isNull(), "class_id", "cls")).alias("best"))
    return named.join(whole, "label").select("cls", "copies", "class_id", "component_id", (F.col("cls") == F.col("best.cls")).alias("stays"))


def components(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id."""
    join = Join(docs, **options)
    named = join.stage.table(named_classes(join), "named")
    alone = join.digests.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    rows = join_hot(join.digests.where("n > 0"), named, "cls", F.xxhash64("doc_id"), "copies", join.rows)
    return alone.unionByName(rows.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, **options) -> DataFrame:
    """docs without those whose component has another row to stay. Rows that a Bloom filter of ids clears pass without a shuffle."""
    join = Join(docs, id_col=id_col, text_col=text_col, width=width, **options)
    named = join.stage.table(named_classes(join), "named")
    rows = join_hot(join.digests.where("n > 0"), named, "cls", F.xxhash64("doc_id"), "copies", join.rows)
    # of the class that stays its smallest id stays
    gone = join.stage.table(rows.where(~(F.col("stays") & F.col("doc_id").eqNullSafe(F.col("class_id")))).select("doc_id", "cls").distinct(), "gone")
    filter_ = docs.sparkSession.sparkContext.broadcast(ids_filter(gone, join.rows))

    def judge(ids: pa.Array, texts: pa.Array) -> pa.Array:
        """The class of those that may go, else null."""
        maybe = np.flatnonzero(_wanted(filter_.value, ids))
        out: list[int | None] = [None] * len(ids)
        for k, s in zip(maybe.tolist(), shingle_sets(texts.take(pa.array(maybe)).to_pylist(), width), strict=True):
            out[k] = class_of(s) if len(s) else None
        return pa.array(out, pa.int64())

    name = free_name(docs, "maybe")
    rows = docs.withColumn(name, F.arrow_udf(judge, "bigint").asNondeterministic()(F.col(id_col).cast("long"), as_bytes(text_col)))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("cls").alias("gone_class"))
    met = rows.where(F.col(name).isNotNull()).alias("d").join(gone.alias("g"), F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("g.gone_id")) & (F.col(f"d.{name}") == F.col("g.gone_class")), "left_anti")
    return rows.where(F.col(name).isNull()).unionByName(met).drop(name)
