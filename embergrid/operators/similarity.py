"""String similarity over blocked pairs, and greedy canonicalisation as fixed-point rounds."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from embergrid.functions import text as T
from embergrid.sources.shared import staged

from . import ranking
from .components import components

ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")  # fixed values
PAIR = StructType([StructField("plain", DoubleType()), StructField("by_token", DoubleType())])
LEVEL = re.compile(r"(?:c|t|l|s|cn)?\d+")


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 LCS / (len a + len b), by bit-parallel LCS."""
    if not a and not b:
        return 100.0
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    s = (1 << len(a)) - 1
    for c in b:
        u = s & place.get(c, 0)
        s = (s + u) | (s - u)
    lcs = len(a) - (s & ((1 << len(a)) - 1)).bit_count()
    return 200.0 * lcs / (len(a) + len(b))


def sorted_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


@F.pandas_udf(PAIR)
def ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"plain": [indel_ratio(x, y) for x, y in zip(a, b, strict=True)], "by_token": [sorted_ratio(x, y) for x, y in zip(a, b, strict=True)]}, dtype=float)


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio in [0, 1]."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


BLOCK_ROWS = 2000
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456"  # any characters would do


def letter_mask(label: Column) -> Column:
    """64 bits: for each counted character whether it stands in the label, and for most whether twice. Two labels' masks differ in
    no more bits than their character counts differ by."""
    times = [F.length(label) - F.length(F.replace(label, F.lit(c), F.lit(""))) for c in COUNTED]
    bits = [(t >= k + 1) for k in (0, 1) for t in times][:63]
    return sum((F.when(b, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, b in enumerate(bits)), F.lit(0).cast("long"))


def token_blocks(tokens: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """tokens (label, token, ...) with _s, the part of its token's block that a label is in, and _u <= _v, a pair of parts: a row for each part it meets.

    A block of n labels has n / block_rows parts, so whatever a token's share of all labels, a key has two parts at most."""
    parts = tokens.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_parts"))
    rows = tokens.join(parts, "token").withColumn("_s", F.pmod(F.xxhash64("label"), F.col("_parts")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return rows.withColumns({"_u": F.least("_s", "_o"), "_v": F.greatest("_s", "_o")}).drop("_o", "_parts")


def near_duplicates(labels: DataFrame, leave_out: tuple[str, ...], least: float = 0.86, block_cap: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distinct labels (column label) that share an informative token and are alike.

    Labels of a token meet part by part. Before the ratio is taken, pairs must pass two bounds of it, by length and by the bits of their
    character counts: at a ratio r at most (1 - r)(len a + len b) characters are not matched. With block_cap, tokens of more labels make no block."""
    tok = labels.select("label", F.explode(F.array_distinct(T.informative(F.col("label"), leave_out, 2))).alias("token"))
    if block_cap is not None:
        few = tok.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= block_cap).select("token")
        tok = tok.join(few, "token", "left_semi")
    rows = token_blocks(tok.withColumn("mask", letter_mask(F.col("label"))), block_rows)
    side = lambda c: rows.select("token", "_u", "_v", F.col("_s").alias(f"s_{c}"), F.col("label").alias(c), F.length("label").alias(f"n_{c}"), F.col("mask").alias(f"m_{c}"))
    short, both = F.least("n_a", "n_b"), F.col("n_a") + F.col("n_b")
    # the ratio is at most 2 short / (short + long)
    may = (2 * short >= least * both) & (F.bit_count(F.col("m_a").bitwiseXOR(F.col("m_b"))) <= (1 - least) * both + 1e-9)
    once = (F.col("_u") == F.col("_v")) | (F.col("s_a") != F.col("s_b"))
    pairs = side("a").join(side("b"), ["token", "_u", "_v"]).where((F.col("a") < F.col("b")) & once & may).select("a", "b").distinct()
    return pairs.withColumn("ratio", block_ratio("a", "b")).where(F.col("ratio") >= least)


def gram_pairs(labels: DataFrame, least: float, q: int = 3) -> DataFrame:
    """Pairs a < b of labels that can reach the ratio: their rarest q-grams meet (plain text, or tokens sorted).

    At a ratio r at most (1 - r)(len a + len b) characters are inserted or deleted, each changes q grams at most; so
    that many rarest grams of a form and one more, for the longest partner allowed, contain a shared one."""
    forms = labels.select("label", F.explode(F.array_distinct(F.array("label", F.array_join(F.array_sort(T.tokens(F.col("label"))), " ")))).alias("form"))
    padded = F.concat(F.lit("\x01" * (q - 1)), "form", F.lit("\x02" * (q - 1)))
    grams = forms.select("label", "form", F.length("form").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length(padded) - q + 1), lambda i: F.substring(padded, i, F.lit(q)))).alias("i", "gram"))
    rank = F.row_number().over(W.partitionBy("label", "form", "gram").orderBy("i"))
    grams = grams.withColumn("gram", F.concat("gram", rank.cast("string")))
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    share = (1 - least) * (1 + (1 + (1 - least)) / (1 - (1 - least)))
    w = W.partitionBy("label", "form").orderBy("df", "gram")
    prefix = grams.join(df, "gram").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.floor(q * F.lit(share) * F.col("n")) + 1).select("label", "gram").distinct()
    return prefix.select("gram", F.col("label").alias("a")).join(prefix.select("gram", F.col("label").alias("b")), "gram").where("a < b").select("a", "b").distinct()


def pairing(alike: np.ndarray) -> np.ndarray:
    """Column for each row of a table of booleans, -1 where none is left: as many pairs as can be."""
    owner = np.full(alike.shape[1], -1)

    def place(row: int, tried: set[int]) -> bool:
        for column in np.flatnonzero(alike[row]).tolist():
            if column not in tried:
                tried.add(column)
                if owner[column] < 0 or place(owner[column], tried):
                    owner[column] = row
                    return True
        return False

    for row in range(len(alike)):
        place(row, set())
    out = np.full(len(alike), -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def mergeable(a: str, b: str, real: set[str], contrast: frozenset[str], suffixes: frozenset[str], least: float = 80.0) -> bool:
    """Whether a is a variant of b: of the tokens that only one of them has, those that tell structures apart (a contrast, a number,
    a level, or a real word that is no suffix) must each be a misspelling of one on the other side; two real words never are."""
    sides = [sorted(set(x.split()) - set(y.split())) for x, y in ((a, b), (b, a))]
    tells = [np.array([t in contrast or t in ROMAN or bool(LEVEL.fullmatch(t)) or (t in real and t not in suffixes) for t in side], bool) for side in sides]
    alike = np.array([[not (x in real and y in real) and max(indel_ratio(x, y), sorted_ratio(x, y)) >= least for y in sides[1]] for x in sides[0]], bool).reshape(len(sides[0]), len(sides[1]))
    mate = pairing(alike)
    lonely = np.ones(len(sides[1]), bool)
    lonely[mate[mate >= 0]] = False
    return not (tells[0][mate < 0].any() or tells[1][lonely].any())


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Labels of one group of candidates, taken in their order: what canonicalise says of each."""
    out, gone = [], set()
    for _, mine in rows.sort_values("own").groupby("own", sort=True):
        label = mine["label"].iloc[0]
        centres = mine[~mine["other"].isin(gone)]
        best = [max(zip(centres[s], -centres["rank"], centres["other"], centres["safe"], strict=True), default=(-1.0, 0, label, False)) for s in ("by_token", "plain")]
        score, _, other, safe = best[0] if best[0][0] >= best[1][0] else best[1]
        if safe:
            gone.add(label)
        out.append((label, other, score) if safe else (label, label, None))
    return pd.DataFrame(out, columns=["label", "canonical", "score"]).astype({"score": float})


def canonicalise(counts: DataFrame, least: float = 90.0, valid=None, contrast: tuple[str, ...] = T.DIRECTIONS + T.LATERALITY, suffixes: tuple[str, ...] = tuple(T.CATEGORIES), lexicon: DataFrame | None = None, together: int = 20_000) -> DataFrame:
    """counts: label, n. Returns label, canonical ('' for labels that `valid` rejects), score.

    Labels count down by frequency, then alphabet. Each meets the most similar centroid before it: from `least` on it merges, if the
    guard lets it, or else becomes a centroid. Labels that hang together by candidates (up to `together` pairs) are settled in
    one task. Of larger groups a round settles every label whose earlier candidates are settled; rounds are as many as the longest chain of candidates. The result is that of
    taking labels one by one."""
    ok = valid(F.col("label")) if valid else F.lit(True)
    good = counts.where(ok)
    tokens = good.select("label", F.explode(F.array_distinct(T.tokens(F.col("label")))).alias("token"))
    real = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df >= 2").select("token")
    if lexicon is not None:
        real = real.unionByName(lexicon.select("token")).distinct()
    mine = tokens.join(real, "token").groupBy("label").agg(F.collect_set("token").alias("real"))
    ranked = ranking.ranged(good.select("label", F.col("n").alias("times")), [], [F.desc("times"), F.col("label")]).join(mine, "label", "left").select("label", "rank", F.coalesce("real", F.array().cast("array<string>")).alias("real"))
    pairs = gram_pairs(good.select("label"), least / 100).withColumn("r", ratios("a", "b")).where((F.col("r.plain") >= least) | (F.col("r.by_token") >= least))
    ra, rb = (ranked.select(F.col("label").alias(c), F.col("rank").alias(f"rank_{c}"), F.col("real").alias(f"real_{c}")) for c in ("a", "b"))
    both = pairs.join(ra, "a").join(rb, "b")
    late = F.col("rank_a") > F.col("rank_b")
    keep, cut = frozenset(contrast), frozenset(suffixes)

    @F.pandas_udf("boolean")
    def guard(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([mergeable(p, q, set(u) | set(v), keep, cut) for p, q, u, v in zip(a, b, x, y, strict=True)], dtype=bool)

    def pick(x, y):
        return F.when(late, F.col(x)).otherwise(F.col(y))
    cand = both.select(pick("a", "b").alias("label"), pick("b", "a").alias("other"), pick("rank_b", "rank_a").alias("rank"), pick("rank_a", "rank_b").alias("own"), F.col("r.plain").alias("plain"), F.col("r.by_token").alias("by_token"), guard(pick("a", "b"), pick("b", "a"), "real_a", "real_b").alias("safe"))
    cand = staged(cand, "candidates")
    free = ranked.select("label").join(cand.select("label").distinct(), "label", "left_anti")
    settled = free.select("label", F.col("label").alias("canonical"), F.lit(None).cast("double").alias("score"))
    # labels that hang together by candidates are settled in one task, in order, where they are few
    key = lambda c: F.xxhash64(c)
    whole = components(cand.select(key("label").alias("a"), key("other").alias("b")))
    met = staged(cand.join(whole.withColumnRenamed("label", "group"), key("label") == F.col("node")).drop("node"), "met")
    small = met.groupBy("group").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= together).select("group")
    settled = staged(settled.unionByName(met.join(small, "group", "left_semi").groupBy("group").applyInPandas(_settle, "label string, canonical string, score double")), "settled")
    while True:
        open_ = cand.join(settled.select("label"), "label", "left_anti")
        if open_.isEmpty():
            break
        known = settled.select(F.col("label").alias("other"), (F.col("label") == F.col("canonical")).alias("centre"))
        seen = open_.join(known, "other", "left").withColumn("ready", F.min(F.col("centre").isNotNull()).over(W.partitionBy("label"))).where("ready")
        centre = F.coalesce("centre", F.lit(False))
        def best(score):
            return F.max(F.when(centre, F.struct(F.col(score).alias("score"), (-F.col("rank")).alias("first"), "other", "safe")))
        top = seen.groupBy("label").agg(best("by_token").alias("t"), best("plain").alias("p"))
        top = top.withColumn("m", F.when(F.col("p").isNull() | (F.col("t.score") >= F.col("p.score")), F.col("t")).otherwise(F.col("p")))
        merged = F.coalesce(F.col("m.safe"), F.lit(False))
        new = top.select("label", F.when(merged, F.col("m.other")).otherwise(F.col("label")).alias("canonical"), F.when(merged, F.col("m.score")).alias("score"))
        settled = staged(settled.unionByName(new), "settled")
    junk = counts.where(~ok).select("label", F.lit("").alias("canonical"), F.lit(None).cast("double").alias("score"))
    return settled.unionByName(junk)


def recoverable(dropped: DataFrame, vocabulary: DataFrame, least: float = 90.0, letters: int = 6) -> DataFrame:
    """Best vocabulary match of dropped labels (label, n) by token-sorted ratio, ties to the first name."""
    long = dropped.where(F.length("label") >= letters)
    every = long.select("label").unionByName(vocabulary.select("label")).distinct()
    pairs = gram_pairs(every, least / 100)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    scored = both.join(long.select(F.col("label").alias("a"), "n"), "a").join(vocabulary.select(F.col("label").alias("b")), "b").withColumn("score", ratios("a", "b")["by_token"]).where(F.col("score") >= least)
    return scored.groupBy(F.col("a").alias("label"), "n").agg(F.min(F.struct((-F.col("score")).alias("s"), "b")).alias("m")).select("label", F.col("m.b").alias("match"), (-F.col("m.s")).alias("score"), "n")


def free_text_correct(rows: DataFrame, free: str, true: str) -> DataFrame:
    """With `correct`: equal after normalising, or all true tokens named, or ratio >= 0.85."""
    f, t = T.normalise_answer(F.col(free)), T.normalise_answer(F.col(true))
    tt, ft = T.tokens(t), T.tokens(f)
    named = (F.size(tt) > 0) & (F.size(F.array_except(tt, ft)) == 0)
    return rows.withColumn("correct", F.when(f == "", False).when((f == t) | named, True).otherwise(block_ratio(f, t) >= 0.85))
