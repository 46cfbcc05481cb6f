"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into a bin; each feature, and each chosen pair of features, has a table of additions.
Boosting goes round the features: a shallow tree (two or three splits of the bins) is fitted to the residuals of one feature at a time and
added, scaled by a small rate, to its table. Then the pairs that explain most of what is left get tables of their
own in the same way. A score is the logistic function of the sum of looked-up additions.

Fitting reads at most ``max_rows`` labelled documents for each label, chosen by a hash of the id (all, where there are fewer);
what reaches the driver is their features, some twenty numbers a row. Weights undo the choice. Scoring reads the whole text of all documents and nothing else.

Cases: very long texts count whole; null and empty texts have features of zero and a score; rows without a label (null or absent) are not learned from; if
fewer than two labels are met, the score is the share of label 1 (0.5 with none); a repeated label row counts as often, by its
weight; documents with a null id are scored and not learned from; equal features have equal scores; empty tables give empty results; extra columns are kept by ``keep_good`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, free_name, small_batches, tidy
from .shingles import groups, word_hashes

MAX_ROWS = 10_000
BINS = 32
FEATURES = (
    "log_bytes", "log_words", "bytes_a_word", "upper", "digit", "space", "newline", "period", "comma", "pipe", "exclamation",
    "symbol", "other_mark", "non_ascii", "distinct_words", "top_word", "same_as_last", "distinct_lines", "quote", "angle",
)


def _among(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


_upper, _digit = np.zeros(256), np.zeros(256)
_upper[65:91], _digit[48:58] = 1, 1
_high = (np.arange(256) >= 128) * 1.0
CLASSES = np.stack([_upper, _digit, _among(" \t\r\x0b\x0c"), _among("\n"), _among("."), _among(","), _among("|"), _among("!"), _among("#$%&*"), _among("+-/:;=?@^_~\\`"), _high, _among("\"'"), _among("<>()[]{}")], 1)


def features(texts: list[bytes]) -> np.ndarray:
    """(texts, features): shares of kinds of bytes, and how much words and lines repeat."""
    out = np.zeros((len(texts), len(FEATURES)))
    row = 0
    for group in groups(texts):
        words, at = word_hashes(group)
        for k, text in enumerate(group):
            n = len(text)
            w = words[at[k] : at[k + 1]]
            share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ CLASSES / (n + 20)
            m = len(w)
            s = np.sort(w)
            edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if m else np.zeros(1, int)
            lines = [x for x in text.split(b"\n") if x]
            # small constants below hold short texts back from extreme shares
            out[row] = (
                np.log1p(n), np.log1p(m), (n + 60) / (m + 10), *share[:11],
                (len(edge) - 1 + 10) / (m + 10), np.diff(edge).max(initial=0) / (m + 10), (w[1:] == w[:-1]).sum() / (m + 10),
                (len(set(lines)) + 2) / (len(lines) + 2), share[11], share[12],
            )
            row += 1
    return out


class AdditiveModel:
    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), int)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for k, t in enumerate(self.tables):
            out += t[bins[:, k]]
        for (a, b), g in zip(self.pairs, self.grids, strict=True):
            out += g[bins[:, a], bins[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _step(g: np.ndarray, h: np.ndarray, splits: int, ridge: float) -> np.ndarray:
    """A tree over ordered bins with that many splits, each the best one left: Newton steps by bin."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    for _ in range(splits):
        best = max(((gain(a, m) + gain(m, b) - gain(a, b), m) for a, b in zip(cuts, cuts[1:], strict=False) for m in range(a + 1, b)), default=(0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _grid_step(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of both bins: four cells, and what they gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    def four(c):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        return a, b, d, c[-1, -1] - a - b - d
    gs, hs = four(cg), four(ch)
    gain = sum(x * x / (y + ridge) for x, y in zip(gs, hs, strict=True))
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(g)
    v = [x[i, j] / (y[i, j] + ridge) for x, y in zip(gs, hs, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit_matrix(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, pairs: int = 6, rate: float = 0.15, splits: int = 3, ridge: float = 10.0) -> AdditiveModel:
    share = float((weight * y).sum() / weight.sum()) if len(y) else 0.5
    if len(y) == 0 or y.min() == y.max():
        model = AdditiveModel([], 0.0)
        model.base = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        return model
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    model = AdditiveModel(edges, float(np.log(share / (1 - share))))
    bins = model.bins(x)
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-margin))
            g, h = np.bincount(bins[:, k], weight * (y - p), len(table)), np.bincount(bins[:, k], weight * p * (1 - p), len(table))
            add = rate * _step(g, h, splits, ridge)
            table += add
            margin += add[bins[:, k]]
    flat = lambda a, b: bins[:, a] * len(model.tables[b]) + bins[:, b]
    def both(a, b, v):
        return np.bincount(flat(a, b), v, len(model.tables[a]) * len(model.tables[b])).reshape(len(model.tables[a]), -1)
    p = 1 / (1 + np.exp(-margin))
    gains = sorted(((-_grid_step(both(a, b, weight * (y - p)), both(a, b, weight * p * (1 - p)), ridge)[0], a, b) for a in range(len(edges)) for b in range(a)))
    model.pairs = [(a, b) for _, a, b in gains[:pairs]]
    model.grids = [np.zeros((len(model.tables[a]), len(model.tables[b]))) for a, b in model.pairs]
    for _ in range(rounds // 2):
        for (a, b), grid in zip(model.pairs, model.grids, strict=True):
            p = 1 / (1 + np.exp(-margin))
            add = rate * _grid_step(both(a, b, weight * (y - p)), both(a, b, weight * p * (1 - p)), ridge)[1]
            grid += add
            margin += add[bins[:, a], bins[:, b]]
    return model


@tidy
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features(b.column(2).to_pylist())
        yield pa.record_batch([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "weight", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", **options) -> AdditiveModel:
    """labels: doc_id and label, of the rows that may be learned from."""
    small_batches(docs.sparkSession)
    labels = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).agg(F.count(F.lit(1)).alias("times"))
    counts = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    if not counts:
        return fit_matrix(np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0))
    share = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, max_rows / n))))
    chosen = labels.withColumn("share", share[F.col("label")]).where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(8)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    # some 2 * max_rows rows of four numbers, whatever the input: small enough for every executor
    texts = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("t"))
    rows = texts.join(F.broadcast(chosen), "id").select("label", (F.col("times") / F.col("share")).alias("weight"), "t")
    got = rows.mapInArrow(_features, "label double, weight double, x array<double>").collect()
    got.sort(key=lambda r: (r.label, r.x))
    y, weight, x = (np.array([r[k] for r in got], float) for k in range(3))
    return fit_matrix(x.reshape(len(y), len(FEATURES)), y, weight, **options)


@tidy
def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array(model.value.score(features(b.column(1).to_pylist())))], names=["doc_id", "score"])


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score, predicted."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), as_bytes(text_col).alias("t")).mapInArrow(partial(_score, model=sent), "doc_id bigint, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: AdditiveModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that the model accepts, with their own columns."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(text: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(features(text.to_pylist())))

    name = free_name(docs, "score")
    return docs.withColumn(name, F.arrow_udf(judge, "double").asNondeterministic()(as_bytes(text_col))).where(F.col(name) >= least).drop(name)
