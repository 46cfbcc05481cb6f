"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Items build one automaton over word ids (several, in
blocks of bounded size, when the items hold more than ``block_words`` words). Documents stream through it word by
word; the state and the longest matching length tell which windows of ``window`` consecutive item words end here. An
item of fewer words, but not none, is one window. Words inside an occurrence are hit.

There is no shuffle: documents are mapped, whatever their length or number of copies. Items are the stated query
set: their words are counted before anything is collected, and one block at a time reaches the driver and the tasks; the hits of several blocks
meet by document.

Cases: null and empty texts have no words, no hits and are not contaminated; items without words are ignored; items
with a null id count as hits without being listed; repeated items and rows are allowed; empty tables give empty or
clean results; very long texts are matched whole. Extra columns are kept by ``remove_contaminated`` and ``cut_spans`` and ignored by ``find_hits``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, as_bytes, free_name, small_batches

WINDOW = 13
BLOCK_WORDS = 100_000
TABLE = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class ItemAutomaton:
    """Suffix automaton of many word sequences; a state stands for the subsequences with equal end positions."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(i, s) for i, t in items if (s := [self.ids.setdefault(w, len(self.ids)) for w in words_of(t)])]
        for _, s in sequences:
            last = 0
            for c in s:
                last = self._extend(last, c)
        self.least = min([window, *(len(s) for _, s in sequences)])
        self.items: dict[int, set] = {}
        ends: dict[int, set] = {}
        for i, s in sequences:
            state = 0
            for k, c in enumerate(s):
                state = self.next[state][c]
                if k + 1 >= window:
                    self.items.setdefault(self._class_of(state, window), set()).add(i)
            if len(s) < window:
                ends.setdefault(self._class_of(state, len(s)), set()).add((len(s), i))
        # per state: the state of its last `window` words, and the short items that end here
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.full, self.short = [0] * len(order), [()] * len(order)
        for v in order[1:]:
            up = self.link[v]
            self.full[v] = v if self.length[up] < window <= self.length[v] else self.full[up]
            self.short[v] = tuple(ends.get(v, ())) + self.short[up]

    def _class_of(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Spans [first word, end) that are hit, and the items with occurring windows."""
        spans: list[list[int]] = []
        found: set = set()
        if len(words) < self.least or not self.ids:
            return spans, found
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        for a, b in edges.reshape(-1, 2)[(edges[1::2] - edges[::2]) >= self.least].tolist():
            self._stream(ids[a:b].tolist(), a, spans, found)
        return spans, found

    def _stream(self, ids: list[int], at: int, spans: list[list[int]], found: set) -> None:
        following, link, length, window = self.next, self.link, self.length, self.window
        state = n = 0
        for k, c in enumerate(ids, at + 1):
            while c not in following[state]:
                state = link[state]
                n = length[state]
            state = following[state][c]
            n += 1
            longest = 0
            if n >= window:
                longest = window
                found |= self.items[self.full[state]]
            for size, item in self.short[state]:
                if size <= n:
                    longest = max(longest, size)
                    found.add(item)
            if longest:
                first = k - longest
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append([first, k])


RESULT = "struct<n_words:bigint,n_hit:bigint,item_ids:array<bigint>,null_item:boolean,spans:array<struct<first:bigint,end:bigint>>>"
SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64())])


def _matcher(automaton):
    """Arrow function text -> RESULT for one block of items."""

    def match(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            words = words_of(t)
            spans, found = automaton.value.match(words)
            out.append({"n_words": len(words), "n_hit": sum(b - a for a, b in spans), "item_ids": sorted(found - {None}), "null_item": None in found, "spans": [{"first": a, "end": b} for a, b in spans]})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.int64())), ("null_item", pa.bool_()), ("spans", pa.list_(SPAN))]))

    return F.arrow_udf(match, RESULT).asNondeterministic()


def _joined(parts: pa.Array) -> pa.Array:
    """Arrow function: the results of several blocks -> one."""
    out = []
    for row in parts.to_pylist():
        spans: list[list[int]] = []
        for s in sorted((s["first"], s["end"]) for p in row for s in p["spans"]):
            if spans and spans[-1][1] >= s[0]:
                spans[-1][1] = max(spans[-1][1], s[1])
            else:
                spans.append(list(s))
        out.append({"n_words": row[0]["n_words"], "n_hit": sum(b - a for a, b in spans), "item_ids": sorted({i for p in row for i in p["item_ids"]}), "null_item": any(p["null_item"] for p in row), "spans": [{"first": a, "end": b} for a, b in spans]})
    return pa.array(out, parts.type.value_type)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple]]:
    """Items in blocks of about block_words words; a block at a time comes to the driver."""
    n, rows = block_count(items, text_col, block_words), items.select(F.col(id_col).cast("long").alias("i"), as_bytes(text_col).alias("t")).distinct()
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, bytes(r.t)) for r in part.collect()]


def block_count(items: DataFrame, text_col: str, block_words: int) -> int:
    letters = F.length(F.coalesce(F.col(text_col), F.lit("")))
    return max(1, -(-(items.agg(F.sum(letters)).first()[0] or 0) // (2 * block_words)))  # two characters a word at least


def _word_count(text: pa.Array) -> pa.Array:
    return pa.array([len(words_of(t)) for t in text.to_pylist()], pa.int64())


def with_hits(docs: DataFrame, items: DataFrame, column: str, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with one more column, a struct: n_words, n_hit, item_ids, null_item, spans.

    Of several blocks one is sent to the tasks at a time: documents are numbered in a table, each block's hits are a table of the documents that have any, and
    these meet by number. So a worker holds one automaton (some 70 MB) however many items there are; documents are then read once for each block."""
    spark = docs.sparkSession
    small_batches(spark)
    blocks = item_blocks(items, item_id, item_text, block_words)
    if block_count(items, item_text, block_words) == 1:
        return docs.withColumn(column, _matcher(spark.sparkContext.broadcast(ItemAutomaton(next(blocks), window)))(as_bytes(text_col)))
    stage, number, size, met = Staging(spark), *(free_name(docs, x) for x in ("number", "words", "met"))
    rows = stage.table(docs.withColumns({number: F.monotonically_increasing_id(), size: F.arrow_udf(_word_count, "bigint")(as_bytes(text_col))}), "numbered")
    found = []
    for block in blocks:
        automaton = stage.send(ItemAutomaton(block, window))
        found.append(stage.table(rows.select(F.col(number).alias("k"), _matcher(automaton)(as_bytes(text_col)).alias("h")).where("h.n_hit > 0"), "hits"))
        stage.recall()
    joined = F.arrow_udf(_joined, RESULT).asNondeterministic()
    hits = reduce(DataFrame.unionByName, found).groupBy("k").agg(F.collect_list("h").alias("h")).select(F.col("k").alias(number), joined("h").alias(met))
    none = F.struct(F.col(size).alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<bigint>").alias("item_ids"), F.lit(False).alias("null_item"), F.array().cast("array<struct<first:bigint,end:bigint>>").alias("spans"))
    return rows.join(hits, number, "left").withColumn(column, F.coalesce(met, none)).drop(number, size, met)


def is_contaminated(hits: str, share: int = 20):
    return (F.col(f"{hits}.n_hit") > 0) & (share * F.col(f"{hits}.n_hit") >= F.col(f"{hits}.n_words"))


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids, spans of hit words, contaminated (hit words are 5 % or more)."""
    text_col = options.get("text_col", "text")
    rows = with_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)), items, "_hits", **options)
    return rows.select("doc_id", "_hits.n_words", "_hits.n_hit", "_hits.item_ids", "_hits.null_item", "_hits.spans", is_contaminated("_hits").alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, share: int = 20, **options) -> DataFrame:
    """The documents whose hit words stay below 1 / share of their words, unchanged."""
    name = free_name(docs, "hits")
    return with_hits(docs, items, name, **options).where(~is_contaminated(name, share)).drop(name)


def cut(text: bytes, spans: list[dict], min_words: int) -> bytes:
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for s in spans:
        if s["end"] - s["first"] >= min_words:
            out.append(text[last : at[s["first"]][0]])
            last = at[s["end"] - 1][1]
    return b"".join([*out, text[last:]])


def cut_spans(docs: DataFrame, items: DataFrame, min_words: int = WINDOW, max_share: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """Delete hit spans of min_words or more from the texts; drop documents whose hit share exceeds max_share."""
    name = free_name(docs, "hits")
    rows = with_hits(docs, items, name, text_col=text_col, **options).where(F.col(f"{name}.n_hit") <= max_share * F.col(f"{name}.n_words"))

    def cutter(text: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut(t.encode(), h["spans"], min_words).decode() for t, h in zip(text.to_pylist(), hits.to_pylist(), strict=True)], pa.string())

    return rows.withColumn(text_col, F.arrow_udf(cutter, "string")(text_col, name)).drop(name)


def items_sha256(ids: str = "item_ids"):
    return F.sha2(F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ",").cast("binary"), 256)
