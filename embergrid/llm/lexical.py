"""Ranked lexical search by two trees, one over the items and one over the documents.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased. A document becomes its number of terms
and the counts of the terms that some item has; this table is written once. From it come N, L and the document frequencies, and
so the weights; a document's coordinates are the integer impacts of its terms.

The items' tree is built on the driver (halved along the direction in which they differ most) and sent to the tasks. A task takes
documents 2,048 at a time, orders them by the item node that suits them best and builds their tree. A node holds the maximum of each
coordinate below it, so the product of two nodes' maxima bounds every score between them; where it stays below the weakest k-th score of the
node's items, or is zero, the whole pair goes. What is left at the leaves is scored exactly. The k-th scores begin with those of a sixteenth of the documents: a k-th
score of some documents is never above that of all, so nothing is lost. Tasks send at most k rows an item.

Items are taken in blocks of about ``block_words`` words, one block after the other over all documents, so what is sent to tasks is bounded (an item is
never split). Scores are sums of integers in doubles below 2^53, in 64-bit integers beyond.

Cases: null or empty texts have no terms, as items they get no rows, as documents they don't count in N; very long texts are taken whole; each document row
stands for itself, also with a null (first among equals) or repeated id; items with equal id and text are one, with equal ids and other texts each has
ranks of its own; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, staged, tidy
from .decontaminate import item_blocks, words_of

K = 10
BLOCK_WORDS = 32_768
CHUNK = 2048  # documents of one tree
DOC_NODES = (256, 16, 4)  # documents of a node, by level; each a multiple of the next
ITEM_NODES = (32, 4, 1)  # items of a node, by level; as many levels
SEED_SHARE = 16
SALTS = 32
VECTOR = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
HIT = "item int, score bigint, doc_id bigint"


@tidy
def _vectors(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    ids = vocabulary.value
    for b in batches:
        size, found = [], []
        for t in b.column(1).to_pylist():
            words = words_of(t)
            size.append(len(words))
            w = np.fromiter(map(ids.get, words, repeat(-1)), np.int32, len(words))
            found.append(np.unique(w[w >= 0], return_counts=True))
        at = np.cumsum([0, *(len(t) for t, _ in found)])
        terms, counts = (np.concatenate([np.zeros(0, np.int32), *(f[k] for f in found)]).astype(np.int32) for k in (0, 1))
        yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), *(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v)) for v in (terms, counts))], names=["doc_id", "n", "terms", "counts"])


@tidy
def _frequencies(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Documents of each term; under -1 those with terms, under -2 all their terms."""
    total, docs, words = np.zeros(size, np.int64), 0, 0
    for b in batches:
        n = b.column(0).to_numpy()
        docs, words = docs + int((n > 0).sum()), words + int(n.sum())
        total += np.bincount(b.column(1).flatten().to_numpy(), minlength=size)
    has = np.flatnonzero(total)
    yield pa.record_batch([pa.array(np.concatenate([[-1, -2], has])), pa.array(np.concatenate([[docs, words], total[has]]))], names=["term", "v"])


def halves(rows: np.ndarray, order: np.ndarray, least: int) -> list[int]:
    """An order in which alike rows are close: halved again and again along the direction of most variance."""
    if len(order) <= least:
        return order.tolist()
    x = rows[order] - rows[order].mean(0)
    v = np.ones(x.shape[1]) + np.arange(x.shape[1]) / x.shape[1]
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1.0
    order = order[np.argsort(x @ v, kind="stable")]
    middle = least * max(1, round(len(order) / least / 2))
    return halves(rows, order[:middle], least) + halves(rows, order[middle:], least)


class ItemTree:
    """Items' weights, ordered and in nodes. `weight` is (terms, items)."""

    def __init__(self, items: list[dict[int, int]], weights: np.ndarray, widths: tuple[int, ...] = ITEM_NODES):
        self.widths = widths
        exact = np.float64 if max([1, *(sum(v.values()) for v in items)]) * widths[0] * float(weights.max(initial=1)) * 1e6 < 1 << 53 else np.int64
        table = np.zeros((len(weights), len(items)), exact)
        for k, v in enumerate(items):
            for t, n in v.items():
                table[t, k] = n * weights[t]
        unit = table.T / np.maximum(np.linalg.norm(table, axis=0)[:, None], 1e-300)
        self.items = np.array(halves(unit, np.arange(len(items)), widths[-1]), np.int64)
        self.weight = np.ascontiguousarray(table[:, self.items])
        self.starts = [np.arange(0, len(items), n) for n in widths]
        self.most = [np.maximum.reduceat(self.weight, s, axis=1) for s in self.starts]
        self.child = [s // n for s, n in zip(self.starts[1:], widths, strict=False)]  # the node above


def impacts(n: np.ndarray, counts: np.ndarray, docs: int, words: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 8 m), with m = 25 + (75 n N) div L; n and counts go side by side."""
    wide = len(n) and int(n.max()) * 75 * docs >= 1 << 62
    m = 25 + ((75 * docs * n.astype(object)) // words).astype(np.int64) if wide else 25 + (75 * docs * n) // max(words, 1)
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


class Search:
    """The k best documents of each item so far, in one task."""

    def __init__(self, tree: ItemTree, docs: int, words: int, k: int, least: np.ndarray, widths: tuple[int, ...] = DOC_NODES):
        self.tree, self.docs, self.words, self.k, self.widths = tree, docs, words, k, widths
        n = len(tree.items)
        self.scores, self.ids = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.least = np.maximum(1, least[tree.items])  # scores below cannot come in
        self.pairs = self.scored = 0

    def add(self, doc_ids: np.ndarray, n: np.ndarray, at: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Documents as rows of a sparse matrix: row k has terms[at[k] : at[k + 1]]."""
        tree = self.tree
        size = np.diff(at)
        used, column = np.unique(terms, return_inverse=True)
        row = np.repeat(np.arange(len(n)), size)
        value = impacts(n[row], counts.astype(np.int64), self.docs, self.words).astype(tree.weight.dtype)
        # documents that suit the same item node best stand side by side
        suits = np.zeros((len(n), len(tree.starts[0])), tree.weight.dtype)
        full = np.flatnonzero(size)
        suits[full] = np.add.reduceat(tree.most[0][terms] * value[:, None], at[full], axis=0) if len(full) else 0
        best = suits.argmax(1)
        order = np.lexsort((-suits[np.arange(len(n)), best], best))
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        row = place[row]
        alive, above = np.ones((1, len(tree.starts[0])), bool), -(-len(n) // self.widths[0]) * self.widths[0]
        for level, (width, items) in enumerate(zip(self.widths, tree.most, strict=True)):
            nodes, items = -(-len(n) // width), items[used]
            most = np.zeros((nodes, len(used)), value.dtype)
            np.maximum.at(most, (row // width, column), value)
            under = alive[:, tree.child[level - 1]] if level else alive
            bound = np.zeros((nodes, items.shape[1]), value.dtype)
            for up, mine in enumerate(under):  # only below pairs that are left
                if mine.any():
                    own = slice(up * above // width, min(nodes, (up + 1) * above // width))
                    bound[own, mine] = most[own] @ (items if mine.all() else items[:, mine])
            alive, above = bound >= np.minimum.reduceat(self.least, tree.starts[level]), width  # scores begin with 1
        most = None
        sort = np.argsort(row, kind="stable")
        row, column, value = row[sort], column[sort], value[sort]
        ends = np.searchsorted(row, np.arange(0, len(n) + self.widths[-1], self.widths[-1]))
        heavy = np.argsort(-bound.max(1), kind="stable")
        for leaf in heavy[alive[heavy].any(1)].tolist():
            nodes = np.flatnonzero(alive[leaf] & (bound[leaf] >= np.minimum.reduceat(self.least, tree.starts[-1])))
            if not len(nodes):
                continue
            mine = np.concatenate([np.arange(s, min(s + tree.widths[-1], len(tree.items))) for s in tree.starts[-1][nodes]])
            a, b = ends[leaf], ends[leaf + 1]
            own, local = np.unique(column[a:b], return_inverse=True)
            first = leaf * self.widths[-1]
            block = np.zeros((min(self.widths[-1], len(n) - first), len(own)), value.dtype)
            block[row[a:b] - first, local] = value[a:b]
            score = (block @ tree.weight[np.ix_(used[own], mine)]).astype(np.int64)
            self.scored += score.size
            into = score >= self.least[mine]
            for j in np.flatnonzero(into.any(0)).tolist():
                rows = np.flatnonzero(into[:, j])
                self._take(int(mine[j]), score[rows, j], doc_ids[order[first + rows]])
        self.pairs += len(n) * len(tree.items)

    def _take(self, item: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.scores[item], score]), np.concatenate([self.ids[item], ids])
        best = np.lexsort((ids, -score))[: self.k]
        self.scores[item], self.ids[item] = score[best], ids[best]
        if len(best) == self.k:
            self.least[item] = max(self.least[item], score[best[-1]])

    def result(self) -> pa.RecordBatch:
        size = [len(s) for s in self.scores]
        ids = np.concatenate([np.zeros(0, np.int64), *self.ids])
        return pa.record_batch([pa.array(np.repeat(self.tree.items, size).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *self.scores])), pa.array(ids, mask=ids == NONE)], names=["item", "score", "doc_id"])


NONE = np.iinfo(np.int64).min  # stands for a null id: first among equals


@tidy
def _search(batches: Iterator[pa.RecordBatch], tree, docs: int, words: int, k: int, least, chunk: int, widths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    search, waiting, rows = Search(tree.value, docs, words, k, least.value if least else np.zeros(len(tree.value.items), np.int64), widths), [], 0

    def go() -> None:
        t = pa.Table.from_batches(waiting).combine_chunks()
        for a in range(0, len(t), chunk):
            c = t.slice(a, chunk).combine_chunks()
            terms, counts = (c.column(x).combine_chunks() for x in (2, 3))
            at = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
            search.add(c.column(0).fill_null(NONE).to_numpy(), c.column(1).to_numpy(), at, terms.flatten().to_numpy(), counts.flatten().to_numpy())

    for b in batches:
        waiting.append(b)
        rows += len(b)
        if rows >= chunk:
            go()
            waiting, rows = [], 0
    if rows:
        go()
    yield search.result()


def top(hits: DataFrame, k: int, *salt) -> DataFrame:
    """The k best rows of each item, and of each salt if one is given; with their rank."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("item", *salt).orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).where(F.col("rank") <= k)


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item, first by salts, so that no task gets what all tasks found for an item."""
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    return top(top(salted, k, "salt").select("item", "score", "doc_id"), k)


def _search_block(docs: DataFrame, block: list[tuple], k: int, chunk: int, doc_nodes: tuple[int, ...], item_nodes: tuple[int, ...]) -> DataFrame | None:
    spark, vocabulary = docs.sparkSession, {}
    items = [(i, w) for i, t in block if (w := words_of(t))]
    vectors = []
    for _, words in items:
        vectors.append({})
        for w in words:
            t = vocabulary.setdefault(w, len(vocabulary))
            vectors[-1][t] = vectors[-1].get(t, 0) + 1
    if not items:
        return None
    size = len(vocabulary)
    rows = staged(docs.mapInArrow(partial(_vectors, vocabulary=spark.sparkContext.broadcast(vocabulary)), VECTOR), "term_counts")
    found = rows.select("n", "terms").mapInArrow(partial(_frequencies, size=size), "term bigint, v bigint").groupBy("term").agg(F.sum("v").alias("v"))
    counts = {r.term: r.v for r in found.collect()}  # a row for each term of the block at most
    n, words = counts.get(-1) or 0, counts.get(-2) or 0
    tree = spark.sparkContext.broadcast(ItemTree(vectors, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * counts.get(t, 0) + 1))) for t in range(size)]), item_nodes))
    rows = rows.where(F.size("terms") > 0)
    search = partial(_search, tree=tree, docs=n, words=words, k=k, chunk=chunk, widths=doc_nodes)
    seeds = rows.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED_SHARE)) == 0).mapInArrow(partial(search, least=None), HIT)
    least = np.zeros(len(items), np.int64)
    for r in best(seeds, k).where(F.col("rank") == k).select("item", "score").collect():  # a row for each item of the block
        least[r.item] = r.score
    hits = best(rows.mapInArrow(partial(search, least=spark.sparkContext.broadcast(least)), HIT), k)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "item int, item_id long")
    return hits.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, chunk: int = CHUNK, doc_nodes: tuple[int, ...] = DOC_NODES, item_nodes: tuple[int, ...] = ITEM_NODES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of each item with the highest scores above 0, equal ones by id."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t"))
    parts = [p for block in item_blocks(items, item_id, item_text, block_words) if (p := _search_block(texts, block, k, chunk, doc_nodes, item_nodes)) is not None]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
