"""Language identification by bit-sliced Bloom filters of n-grams.

A filter is an array of slots; each slot holds one bit for every language. An n-gram's two slots, and-ed, give a bit mask of
the languages that have it. Per document the masks of all its n-grams are counted language by language; counts are corrected for
each language's false-positive rate (from its own share of set bits), and the largest corrected share decides.

N-grams are ``width`` bytes of lower-cased UTF-8 with everything but letters' bytes as one space. A language has an n-gram if
its share there is at least ``contrast`` times the largest share of any language, and it was met ``least`` times.

Learning reads at most ``max_docs`` documents a language, chosen by a hash of the id (all, where there are fewer), as
whole texts. Scoring reads whole texts of all documents and nothing but the text.

Cases: very long texts are scored by all their n-grams; null texts and texts without a letter are ``und`` with score 0; texts with letters of no known n-gram get the most frequent
learned language with score 0; ties go to the first language by name; rows with a null lang are not learned from; with nothing to
learn from, all is ``und``; null ids have remainder 0 and are learned from; a letter is what Unicode calls one (not a number sign); empty tables give empty results; extra columns are ignored; repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staging, as_bytes, next_pow2, small_batches, tidy
from .shingles import groups, mix

WIDTH = 4
MAX_DOCS = 2_000
WORD_SIGN = re.compile(r"[^\W\d_]")  # letters, and number signs such as the half
_U = np.uint64
#: Lower-cased ASCII letters and all bytes of other characters stay; anything else is a space.
CLEAN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def grams_of(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all texts as numbers, and the text of each; runs of spaces count once."""
    raw = CLEAN[np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    keep = np.concatenate([(raw[1:] != 32) | (raw[:-1] != 32), [False]])
    keep[-1] = False
    keep = keep[: len(owner)]
    raw, owner = raw[: len(owner)][keep], owner[keep]
    if len(raw) < width:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    gram = np.zeros(len(raw) - width + 1, _U)
    for k in range(width):
        gram = (gram << _U(8)) | raw[k : len(gram) + k]
    same = owner[: len(gram)] == owner[width - 1 :]
    return gram[same], owner[: len(gram)][same]


def has_letter(text: bytes) -> bool:
    return any(m[0].isalpha() for m in WORD_SIGN.finditer(text.decode("utf-8", "replace")))


class LanguageFilter:
    """Slots of one bit a language; more than 64 languages take more than one word a slot."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], prior: list[float], width: int, bits_per_gram: int = 16):
        self.languages, self.width = languages, width
        self.fallback = int(np.argmax(prior)) if prior else -1
        slots = next_pow2(max(1 << 12, bits_per_gram * max([len(g) for g in grams], default=1)))
        words = max(1, -(-len(languages) // 64))
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        self.slots = np.zeros((slots, words), kind)
        for k, g in enumerate(grams):
            for at in self._at(g):
                self.slots[at, k // 64] |= kind(1 << (k % 64))
        share = np.array([self._bit(self.slots, k).mean() for k in range(len(languages))])
        self.false_positive = np.minimum(share**2, 0.99)

    def _at(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, low = mix(gram), _U(len(self.slots) - 1)
        return (h & low).astype(np.int64), ((h >> _U(32)) & low).astype(np.int64)

    @staticmethod
    def _bit(masks: np.ndarray, k: int) -> np.ndarray:
        return (masks[:, k // 64] >> masks.dtype.type(k % 64)) & masks.dtype.type(1)

    def score(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        pred, score = [], []
        for group in groups(texts):
            gram, owner = grams_of(group, self.width)
            a, b = self._at(gram)
            masks = self.slots[a] & self.slots[b]
            total = np.bincount(owner, minlength=len(group))
            hits = np.array([np.bincount(owner, self._bit(masks, k), len(group)) for k in range(len(self.languages))]).reshape(len(self.languages), len(group))
            fp = self.false_positive[:, None]
            true = np.maximum(hits - fp * total, 0) / (1 - fp)
            whole = true.sum(0)
            for d, text in enumerate(group):
                if not self.languages or not has_letter(text):
                    pred.append("und")
                    score.append(0.0)
                elif whole[d] > 0:
                    k = int(true[:, d].argmax())
                    pred.append(self.languages[k])
                    score.append(float(min(1.0, true[k, d] / whole[d])))
                else:
                    pred.append(self.languages[self.fallback])
                    score.append(0.0)
        return pred, score


@tidy
def _count(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, gram, n: sums over a batch."""
    for b in batches:
        lang, text = b.column(0).to_pylist(), b.column(1).to_pylist()
        for name in sorted(set(lang)):
            n_all = {}
            for group in groups([t for l, t in zip(lang, text, strict=True) if l == name]):
                for g, n in zip(*(x.tolist() for x in np.unique(grams_of(group, width)[0], return_counts=True)), strict=True):
                    n_all[g] = n_all.get(g, 0) + n
            yield pa.record_batch([pa.array([name] * len(n_all), pa.string()), pa.array(np.fromiter(n_all, np.uint64, len(n_all)).view(np.int64)), pa.array(n_all.values(), pa.int64())], names=["lang", "gram", "n"])


def fit(rows: DataFrame, width: int = WIDTH, max_docs: int = MAX_DOCS, least: int = 3, contrast: float = 0.2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageFilter:
    """rows: doc_id, text, lang. At most about max_docs documents a language are read, all n-grams of which count."""
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageFilter([], [], [], width)
    languages = sorted(counts)
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, max_docs / n)))
    chosen = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    stage = Staging(rows.sparkSession)
    grams = stage.table(chosen.select("lang", as_bytes().alias("t")).mapInArrow(partial(_count, width=width), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    total = {r.lang: r.n for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    number = F.create_map(*(F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)))
    rate = F.col("n") / F.create_map(*(F.lit(x) for k, n in total.items() for x in (k, float(n))))[F.col("lang")]
    # one row a gram: its languages as bits, 63 to a word
    met = grams.select("gram", F.struct(number[F.col("lang")].alias("k"), "n", rate.alias("rate")).alias("x")).groupBy("gram").agg(F.collect_list("x").alias("x"), F.max("x.rate").alias("most"))
    has = F.filter("x", lambda x: (x["n"] >= least) & (x["rate"] >= contrast * F.col("most")))
    word = lambda w: F.aggregate(F.filter(has, lambda x: F.floor(x["k"] / 63) == w), F.lit(0).cast("long"), lambda a, x: a + F.call_function("shiftleft", F.lit(1).cast("long"), (x["k"] % 63).cast("int")))
    kept = met.select("gram", *(word(w).alias(f"m{w}") for w in range(-(-len(languages) // 63)))).where(" or ".join(f"m{w} <> 0" for w in range(-(-len(languages) // 63)))).toArrow()
    stage.drop("grams")
    gram, masks = kept.column(0).to_numpy().view(_U), [c.to_numpy() for c in kept.columns[1:]]
    own = [np.sort(gram[(masks[k // 63] >> (k % 63)) & 1 == 1]) for k in range(len(languages))]
    return LanguageFilter(languages, own, [counts[k] for k in languages], width)


@tidy
def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pred, score = model.value.score(b.column(1).to_pylist())
        yield pa.record_batch([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t")).mapInArrow(partial(_predict, model=sent), "doc_id bigint, lang_pred string, score double")


def remainder(mod: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo mod; a null id counts as the empty text, so its remainder is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))
