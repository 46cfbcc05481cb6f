"""Token blocks in parts, and the queries on label pairs, against all pairs in plain Python."""

import collections
import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from embergrid.functions import text as T
from embergrid.operators import relations as L
from embergrid.operators import similarity as S
from embergrid.plans import QUERIES
from embergrid.plans import q_text as Q

OUT = set(L.CATEGORY_WORDS + L.GENERIC)


def words(label):
    return {t for t in label.split() if t not in OUT and len(t) >= 2}


def alike(labels, least=0.86, cap=None):
    held = collections.Counter(t for x in labels for t in words(x))
    ok = lambda a, b: any(cap is None or held[t] <= cap for t in words(a) & words(b))
    return {(a, b) for a in labels for b in labels if a < b and ok(a, b) and difflib.SequenceMatcher(None, a, b).ratio() >= least}


@pytest.mark.parametrize("cap", [None, 30])
@pytest.mark.parametrize("block_rows", [2000, 9])
def test_parts_of_blocks_equal_all_pairs(spark, cap, block_rows):
    rng = np.random.default_rng(1)
    names = ["".join(rng.choice(list("abcde"), rng.integers(2, 6))) for _ in range(40)]
    labels = sorted({f"common {rng.choice(names)} {rng.choice(names)}" for _ in range(120)} | {"left common", "Common Ü9", "7 common 7", "solo"})
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    got = [(r.a, r.b) for r in S.near_duplicates(df, L.CATEGORY_WORDS + L.GENERIC, block_cap=cap, block_rows=block_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == alike(labels, cap=cap)


def test_a_token_of_twenty_thousand_labels(spark):
    """One token in all labels: no key holds more than two parts, and the pairs are those planted."""
    rng = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    base = sorted({"".join(rng.choice(letters, 12)) for _ in range(20_000)})
    planted = [f"shared {x[:11]}{'z' if x[11] != 'z' else 'a'}" for x in base[:50]]
    labels = [f"shared {x}" for x in base] + planted
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    tok = df.select("label", F.lit("shared").alias("token"))
    sizes = [r["count"] for r in S.token_blocks(tok).groupBy("token", "_u", "_v").count().collect()]
    assert max(sizes) < 2 * S.BLOCK_ROWS * 1.1 and len(sizes) == 66
    got = {(r.a, r.b) for r in S.near_duplicates(df, (), least=0.9).collect()}
    assert {tuple(sorted((p, f"shared {x}"))) for p, x in zip(planted, base, strict=False)} <= got
    assert all(difflib.SequenceMatcher(None, a, b).ratio() >= 0.9 for a, b in got)


def test_masks_bound_the_difference_of_counts(spark):
    rng = np.random.default_rng(3)
    labels = ["".join(rng.choice(list("aabbcdz019 -é"), rng.integers(0, 12))) for _ in range(60)]
    mask = {r.label: r.m & (1 << 64) - 1 for r in spark.createDataFrame([(x,) for x in labels], "label string").select("label", S.letter_mask(F.col("label")).alias("m")).collect()}
    for a in labels:
        for b in labels:
            x, y = collections.Counter(a), collections.Counter(b)
            assert (mask[a] ^ mask[b]).bit_count() <= ((x - y) + (y - x)).total()


def test_cross_source_query(spark, data):
    sources = collections.defaultdict(set)
    for r in Q.labels(spark, data).select("label", "source").collect():
        sources[r.label].add(r.source)
    want = {(a, b) for a, b in alike(sorted(sources)) if sources[a] != sources[b]}
    got = {(r.a, r.b): r for r in QUERIES["q_cross_source_near_dups"](spark, data).collect()}
    assert set(got) == want and all(r.from_a == "+".join(sorted(sources[a])) and abs(r.ratio - difflib.SequenceMatcher(None, a, b).ratio()) < 1e-6 for (a, b), r in got.items())


def test_recoverable_labels(spark):
    """The best match of each rare label by the ratio of sorted tokens, against all pairs."""
    rng = np.random.default_rng(6)
    names = ["".join(rng.choice(list("aeiomnrstl"), 7)) for _ in range(25)]
    known = sorted({f"{rng.choice(names)} {rng.choice(names)}" for _ in range(60)})
    rare = {" ".join(reversed(k.split())): 1 for k in known[:10]} | {k[:-1] + "x": 2 for k in known[10:30]} | {k[1:]: 1 for k in known[30:35]} | {"short": 1, "nothing like it": 2}
    rare = {k: n for k, n in rare.items() if k not in known}
    want = {}
    for label, n in rare.items():
        score, _, match = min((-S.sorted_ratio(label, v), i, v) for i, v in enumerate(known))
        if len(label) >= 6 and -score >= 90:
            want[label] = (match, round(-score, 6), n)
    frame = spark.createDataFrame(list(rare.items()), "label string, n long")
    got = {r.label: (r.match, round(r.score, 6), r.n) for r in S.recoverable(frame, spark.createDataFrame([(k,) for k in known], "label string")).collect()}
    assert got == want and len(want) > 20


def test_recoverable_query(spark, data):
    """No rare label of the small tables is near a frequent one; the query says so, too."""
    counts = collections.Counter(r.label for r in Q.labels(spark, data).select("label").collect())
    known = [x for x, n in counts.items() if n >= 3]
    near = {x for x, n in counts.items() if n < 3 and len(x) >= 6 and any(S.sorted_ratio(x, v) >= 90 for v in known)}
    assert {r.label for r in QUERIES["q_recoverable"](spark, data).collect()} == near


def test_merge_log_query(spark, data):
    """The log is what the label-by-label loop merges."""
    counts = collections.Counter(r.label for r in Q.labels(spark, data).select("label").collect())
    df = collections.Counter(t for x in counts if len(x) >= 4 for t in set(x.split()))
    real, centres, want = {t for t, n in df.items() if n >= 2}, [], {}
    keep, cut = frozenset(T.DIRECTIONS + T.LATERALITY), frozenset(T.CATEGORIES)
    for label in sorted((x for x in counts if len(x) >= 4), key=lambda x: (-counts[x], x)):
        best = {f: max(((f(label, c), -k, c) for k, c in enumerate(centres)), default=(0.0, 0, "")) for f in (S.sorted_ratio, S.indel_ratio)}
        score, _, other = best[S.sorted_ratio] if best[S.sorted_ratio][0] >= best[S.indel_ratio][0] else best[S.indel_ratio]
        mine = {t for t in (label + " " + other).split() if t in real}
        if score >= 90 and S.mergeable(label, other, mine, keep, cut):
            want[label] = (other, round(score, 3))
        else:
            centres.append(label)
    got = {r.label: (r.canonical, r.score) for r in QUERIES["q_merge_log"](spark, data).collect()}
    assert got == want


@pytest.mark.parametrize("together", [20_000, 1, 0])
def test_groups_and_rounds_canonicalise_alike(spark, data, together):
    """Settled in one task, in rounds, or some of either: the same."""
    counts = Q.labels(spark, data).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    got = {r.label: (r.canonical, None if r.score is None or r.score != r.score else round(r.score, 6)) for r in S.canonicalise(counts, valid=lambda c: F.length(c) >= 4, together=together).collect()}
    real = {t for t, n in collections.Counter(t for x in got if len(x) >= 4 for t in set(x.split())).items() if n >= 2}
    keep, cut = frozenset(T.DIRECTIONS + T.LATERALITY), frozenset(T.CATEGORIES)
    n, centres = {r.label: r.n for r in counts.collect()}, []
    for label in sorted(n, key=lambda x: (-n[x], x)):
        if len(label) < 4:
            assert got[label][0] == ""
            continue
        best = {f: max(((f(label, c), -k, c) for k, c in enumerate(centres)), default=(0.0, 0, "")) for f in (S.sorted_ratio, S.indel_ratio)}
        score, _, other = best[S.sorted_ratio] if best[S.sorted_ratio][0] >= best[S.indel_ratio][0] else best[S.indel_ratio]
        merges = score >= 90 and S.mergeable(label, other, {t for t in (label + " " + other).split() if t in real}, keep, cut)
        assert got[label] == ((other, round(score, 6)) if merges else (label, None))
        if not merges:
            centres.append(label)
