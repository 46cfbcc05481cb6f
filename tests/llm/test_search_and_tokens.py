"""Whitening, lexical search and SentencePiece against brute force, SQL and the library."""

import collections
import hashlib
import math
import re

import duckdb
import numpy as np
import pytest

from embergrid.llm import lexical, oracles, pieces, queries, tokens, whitening

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# -- 11


def brute_whitening(vectors):
    """Plain NumPy on Python integers: x, S, eigenvalues, whitened, deviations."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    c = n * x - s
    centred = c.astype(float) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    order = np.argsort(-e)[:8]
    return n, (c**2).sum(1), e[order], centred @ (u[:, order] / np.sqrt(e[order])), np.trace(cov)


def test_whitening_query_equals_numpy(spark, data):
    rows = {r.vec_id: [float(np.float32(c)) for c in r.embedding] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    ids = sorted(rows)
    n, deviation, e, white, trace = brute_whitening([rows[i] for i in ids])
    got = collections.defaultdict(dict)
    for r in queries.op11_embedding_whitening(spark, data).collect():
        got[r.vec_id][r.component] = r
        assert r.n == n and abs(r.explained - e[r.component - 1] / trace) < 1e-9 and r.identity_error < 1e-9
    assert sorted(got) == ids and all(sorted(v) == list(range(1, 9)) for v in got.values())
    assert [got[i][1].deviation for i in ids] == deviation.tolist()
    for k in range(8):
        mine = np.array([got[i][k + 1].whitened for i in ids])
        assert min(np.abs(mine - white[:, k]).max(), np.abs(mine + white[:, k]).max()) < 1e-7


@pytest.mark.parametrize("top", [1, 2, 900, 1 << 20, 1 << 40, (1 << 62) - 1])
def test_bit_planes_give_exact_products(top):
    rng = np.random.default_rng(top % 1000)
    u = rng.integers(0, top, (131, 5), endpoint=True)
    assert (whitening.cross_products(u).astype(object) == u.astype(object).T @ u.astype(object)).all()


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 5.0]), (1, [1.0, 2.0, 5.0]), (None, [0.5, -3.0, 5.0]), (2, None), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [1.0, inf, 1.0]), (6, []), (7, [1.0]), (8, [1e30, 0.0, 5.0]), (9, [-1e30, 0.0, 5.0])]
    frame = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<float>, n long, whitened string").repartition(3)
    got = whitening.report(frame.where("vec_id is null or vec_id < 8"), whitening.fit(frame.where("vec_id is null or vec_id < 8"))).collect()
    n, deviation, e, white, _ = brute_whitening([r[1] for r in rows[:3]])
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (1, 1), (1, 1)]  # one direction has variance
    assert {(r.vec_id, int(r.deviation)) for r in got} == {(1, int(deviation[0])), (None, int(deviation[2]))}
    assert {round(abs(r.whitened), 9) for r in got} == {round(abs(v), 9) for v in white[:, 0]}
    huge = whitening.report(frame, whitening.fit(frame)).where("vec_id in (8, 9)").collect()
    assert len(huge) >= 2 and all(np.isfinite(r.whitened) for r in huge) and len({round(r.whitened, 6) for r in huge if r.component == 1}) == 2
    for few in (frame.limit(0), frame.where("vec_id = 1"), frame.where("vec_id = 2")):
        assert whitening.report(few, whitening.fit(few)).isEmpty()


def test_mixed_lengths_take_the_commonest(spark):
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)] + [(9, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    model = whitening.fit(frame)
    assert (model.dims, model.n) == (2, 4) and {r.vec_id for r in whitening.whiten(frame, model).collect()} == {0, 1, 2, 3}


# -- 12


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute_search(docs, items, k=10):
    counted = [(d, collections.Counter(terms(t))) for d, t in docs]
    n, words = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = collections.Counter()
    for i, text in dict.fromkeys(items):
        found = []
        for d, c in counted:
            m = 25 + (75 * sum(c.values()) * n) // words if words else 0
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in collections.Counter(terms(text)).items() if c[t])
            if score > 0:
                found.append((-score, -1 if d is None else d, d))
        out.update((i, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1))
    return out


def test_search_equals_sql(spark, data):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    got = queries.op12_lexical_search(spark, data).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(oracles.ORACLES["op12_lexical_search"]).fetchall())


@pytest.mark.parametrize("chunk, block", [(2048, 32_768), (7, 12)])
def test_search_equals_brute_force(spark, chunk, block):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(30)] + ["É", "the", "3rd"]
    share = np.arange(len(vocabulary), 0, -1) ** 2.0
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=share / share.sum()))
    docs = [(int(d), draw(rng.integers(0, 12))) for d in rng.permutation(150)] + [(None, "W1 the"), (7, "w1; THE"), (7, "w1; THE"), (500, None), (501, "..."), (502, "the " * 9_000)]
    items = [(i, draw(rng.integers(1, 6))) for i in range(25)] + [(3, "the the w1"), (3, "the the w1"), (30, None), (31, "?"), (None, "w2"), (40, "nowhere"), (41, "w1 " * 300)]
    frame = spark.createDataFrame([(*d, 1, 2.5) for d in docs], "doc_id long, text string, rank int, score double").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")
    got = collections.Counter(map(tuple, lexical.search(frame, asked, block_words=block, chunk=chunk, doc_nodes=(4, 2), item_nodes=(4, 2)).select("item_id", "rank", "doc_id", "score").collect()))
    assert got == brute_search(docs, items)
    if block > 100:
        assert lexical.search(frame.limit(0), asked).isEmpty() and lexical.search(frame, asked.limit(0)).isEmpty()


def test_node_bounds_prune_and_lose_nothing():
    """Groups of documents and items that share no terms: most pairs are never scored."""
    rng = np.random.default_rng(3)
    vectors = [{int(t): 1 for t in rng.choice(20, 6, replace=False) + 20 * (k % 8)} for k in range(64)]
    tree = lexical.ItemTree(vectors, np.full(160, 700, np.int64))
    search = lexical.Search(tree, 4096, 40_000, 10, np.zeros(64, np.int64))
    for a in (0, 2048):
        rows = [np.sort(rng.choice(20, 10, replace=False)) + 20 * int(g) for g in rng.integers(0, 8, 2048)]
        search.add(np.arange(a, a + 2048), np.full(2048, 10), np.arange(2049) * 10, np.concatenate(rows), np.ones(20_480, np.int64))
    assert search.scored < search.pairs / 4 and all(len(s) == 10 for s in search.scores)


def test_large_weights_use_integers():
    tree = lexical.ItemTree([{0: 10**6}, {1: 1}], np.array([40_000, 40_000]))
    assert tree.weight.dtype == np.int64 and lexical.ItemTree([{0: 5}], np.array([40_000])).weight.dtype == np.float64
    wide = lexical.impacts(np.array([10**12]), np.array([3]), 10**9, 10**15)
    assert wide.tolist() == [(3 * 10**9) // (3000 + 8 * (25 + 75 * 10**12 * 10**9 // 10**15))]


# -- 13


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokens.tokenizer_path(pieces.MODEL))


ODD = ["", " ", "  ", "a", " a ", "a" * 20_000, "=" * 3_000, " " * 999, "▁" * 77 + " " * 50, "x▁ ▁ y", "\n\n a\n", "</s> <0x0A> <unk>", "\x00\x00", "漢字 😀é", "word " * 30_000, "0123456789" * 50]


def test_pieces_equal_the_library(library):
    rng = np.random.default_rng(2)
    bits = ["a", "e", "in", "the", " ", "  ", "    ", "\n", "\t", "▁", "é", "漢", "字", "😀", "=", "==", "-", "1", "23", ".", "'s", "\x00", "<0x0A>", "</s>", "A", "ing", "tion", "　", "\xa0"]
    texts = ODD + ["".join(rng.choice(bits, rng.integers(1, 40))) for _ in range(8_000)]
    want = [[*library.encode(t), 2] for t in texts]
    for own in (pieces.PieceTokenizer(tokens.tokenizer_path(pieces.MODEL)), pieces.PieceTokenizer(tokens.tokenizer_path(pieces.MODEL), 20)):
        ids, counts = own.encode_texts([t.encode() for t in texts])
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
        assert own.decode(ids, counts) == [library.decode(w).encode() for w in want]


def test_backtracking_is_needed_and_marks_positions():
    """The longest first piece is not always the right one."""
    model = pieces.PieceModel(tokens.tokenizer_path(pieces.MODEL))
    rng = np.random.default_rng(4)
    words = ["▁" + "".join(rng.choice(list("aeinorstlh"), rng.integers(2, 14))) for _ in range(4_000)]

    def greedy(w):
        out = []
        while w:
            n = next(k for k in range(len(w), 0, -1) if w[:k] in model.ids)
            out.append(model.ids[w[:n]])
            w = w[n:]
        return out

    def merged(w):
        parts = list(w)
        while found := [(-model.score[model.ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in model.ids]:
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [model.ids[p] for p in parts]

    assert all(model.encode(w) == merged(w) for w in words) and any(greedy(w) != merged(w) for w in words)


def test_decoding_any_ids(library):
    own = pieces.PieceTokenizer(tokens.tokenizer_path(pieces.MODEL))
    rng = np.random.default_rng(6)
    rows = [rng.integers(0, 600, rng.integers(0, 9)).tolist() for _ in range(500)] + [[1, 264], [0], [2], [], [3 + 0xE6, 3 + 0xBC], [28705, 28705]]
    flat = np.array([i for r in rows for i in r], np.int64)
    assert own.decode(flat, np.array(list(map(len, rows)))) == [library.decode(r).encode() for r in rows]


def test_sentencepiece_query(spark, library, tmp_path):
    rows = [*enumerate(ODD), (None, "lost id"), (5, None), (5, None)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, n_tokens long, ids string").write.parquet(f"{folder}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(i) + 1, sha(" ".join(map(str, [*i, 2])).encode()), sha(library.decode([*i, 2]).encode())) for d, t in rows for i in [library.encode(t or "")]]
    got = queries.op13_sentencepiece(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    back = pieces.decode(pieces.encode(docs))
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((d, (t or "").replace("▁", " "))) for d, t in rows)
    assert pieces.digests(pieces.encode(docs.limit(0))).isEmpty() and pieces.decode(spark.createDataFrame([(1, None), (2, [264, None])], "doc_id long, ids array<int>")).count() == 2


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(tokens.tokenizer_path(pieces.MODEL), "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="normalisation"):
        pieces.PieceModel(str(tmp_path / "m"))
    with pytest.raises(ValueError, match="byte-level"):
        tokens.ChunkTokenizer(tokens.tokenizer_path("word_bpe_49k.json"))


# -- 6: the map is stored, edited and read back


def test_sharding_query_edits_its_map(spark, data, tmp_path):
    from embergrid.llm import sharding

    rows = queries.op6_sharding(spark, data).collect()
    assert all(r.moved == (r.next_shard == 40) == (r.shard != r.next_shard) for r in rows) and any(r.moved for r in rows)
    held = collections.Counter()
    for r in rows:
        held[r.next_shard] += r.size
    assert held[40] > 0.9 * sum(held.values()) / 41 or max(r.size for r in rows) > sum(held.values()) / 41
    path = f"file://{tmp_path}/map"
    sharding.save_map(spark, [0, 1], path, 1)
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.save_map(spark, [1, 0], path, 1)


# -- 10: filters by ranges of digests


@pytest.mark.parametrize("max_bits", [1 << 30, 1 << 13, 1 << 14])
def test_small_filters_let_no_more_rows_through(spark, max_bits):
    """4,000 rows at 16 bits need 65,536: with filters of an eighth of that, ranges keep the share of unique rows that shuffle where it was."""
    from embergrid.llm import exact_dedup

    rows = [(i, f"text number {i // 2 if i < 1200 else i}" + " " * (i % 3)) for i in range(4000)] + [(None, "text number 7"), (5000, None), (5001, " \t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    copies = exact_dedup.Copies(docs, "doc_id", "text", 16, max_bits)
    groups = collections.Counter("".join((t or "").split()) for _, t in rows)
    repeated = sum(n for n in groups.values() if n > 1)
    assert copies.rows.count() == len(rows) and repeated <= copies.rows.where("maybe").count() <= repeated + 0.02 * len(rows)
    best = {}
    for i, t in rows:
        k = "".join((t or "").split())
        best[k] = max(best.get(k, (-1, 0, 0)), (len(t or ""), i is not None, -(i or 0)))
    got = exact_dedup.mark_copies(docs, max_bits=max_bits).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.keep_id, r.group_size) for r in got} == {i: (-best[k][2] if best[k][1] else None, groups[k]) for i, t in rows for k in ["".join((t or "").split())]}
    kept = exact_dedup.drop_copies(docs, max_bits=max_bits)
    assert sorted((r.doc_id or -1 for r in kept.collect())) == sorted((-b[2] if b[1] else -1) for b in best.values())
