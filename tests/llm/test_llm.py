"""The training-data operators against brute force, SQL, round trips and held-out labels."""

import base64
import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from embergrid.llm import chat, decontaminate, exact_dedup, jaccard, langid, oracles, packing, quality, queries, sharding, shingles, token_files, tokens, warc

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (1, "The cat sat on the mat, and the dog lay by the door of the house."), (2, "the CAT sat on\tthe mat, and the dog lay by the door of the  house."), (3, None), (4, ""), (5, " \n\t"), (6, "x"),
    (7, "word " * 30_000), (8, "x"), (8, "x"), (None, "lost id"), (9, "é ü ß 漢字 <|endoftext|> \x00\x00a  　b"), (10, "a" * 5_000),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0, True, "k", 1.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, sha string, score double")


def test_sql(spark, data):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    for name, sql in oracles.ORACLES.items():
        df, want = queries.QUERIES[name](spark, data), con.sql(sql)
        order = sorted(df.columns)
        assert order == sorted(want.columns)
        at = [want.columns.index(c) for c in order]
        assert sorted(tuple(r) for r in df.select(*order).collect()) == sorted(tuple(r[k] for k in at) for r in want.fetchall()), name


# -- 1


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute_hits(docs, items, window=13):
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i, t in items:
            iw = words(t)
            n = min(window, len(iw))
            wins = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add(i)
        out[d] = (len(w), len(hit), sorted(found))
    return out


ITEMS = [(1, "the quick brown fox"), (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"), (3, "fox"), (4, ""), (5, None), (6, "five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"), (2, "the the the")]
TEXTS = ["A quick BROWN fox; the quick brown fox!", "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen", "the the the the", "nothing here", "", None, "fox " * 50]


@pytest.mark.parametrize("block", [100_000, 8])
def test_suffix_automaton_equals_brute_force(spark, block):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in decontaminate.find_hits(docs, items, block_words=block).collect()}
    assert got == brute_hits(list(enumerate(TEXTS)), ITEMS)


def test_random_windows_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        items = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 9)))) for i in range(4)]
        text = " ".join(rng.choice(list("abcd"), 40))
        spans, found = decontaminate.ItemAutomaton([(i, t.encode()) for i, t in items], 4).match(decontaminate.words_of(text.encode()))
        n, hit, ids = brute_hits([(0, text)], items, 4)[0]
        assert (sum(b - a for a, b in spans), sorted(found)) == (hit, ids)


def test_decontamination_odd_rows(spark, odd):
    items = spark.createDataFrame([(None, "cat sat"), (1, "dog lay")], "item_id long, text string")
    clean = decontaminate.remove_contaminated(odd, items)
    assert clean.columns == odd.columns and clean.count() == len(ODD) - 2
    assert decontaminate.find_hits(odd, items.limit(0)).where("contaminated or n_hit > 0").isEmpty()
    assert decontaminate.find_hits(odd.limit(0), items).isEmpty()
    cut = {r.doc_id: r.text for r in decontaminate.cut_spans(odd, items, min_words=2).where("doc_id = 1").collect()}
    assert cut[1] == "The  on the mat, and the  by the door of the house."


# -- tokens, 2, 9


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_chunked_ids_are_the_whole_texts(plain):
    texts = ["", " ", "  a", "a  ", "a\n\nb", "\n b", "it's ok, don't", "x.\nY é,ü! ×÷.", "<|endoftext|>", "\x00\x00a \x00\x00b", "a b 　c", " \x1c b", "漢 字。", "1st 22nd, 3.14", *(t or "" for _, t in ODD)]
    few = tokens.ChunkTokenizer(tokens.tokenizer_path(), 5)
    for t in texts:
        assert few.encode(t).tolist() == plain(t), t[:40]
    ids, counts = few.encode_many([t.encode() for t in texts], 7)
    assert ids.tolist() == [i for t in texts for i in [*plain(t), 7]] and counts.sum() == len(ids)


SPECIAL = "end.<|endoftext|>Next"


def test_special_ids_are_the_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.tokenizer_path())
    e = "<|endoftext|>"
    texts = [SPECIAL, e, e + e, f"a  {e}  b", f" {e} {e}\n{e}\nb", f"a\n{e} x", f"<{e}>", "<|endof", "text|>", f"{e[:-1]}{e}", "x", f"it's{e}'s é{e}é", f"\n\n{e}\n\n b ", "word " * 30_000 + e]
    rng = np.random.default_rng(1)
    texts += ["".join(rng.choice([e, " ", "\n", "a", "B1", ".", "é", "<|", "|>", "'s", "\t"], 12)) for _ in range(2_000)]
    few = tokens.ChunkTokenizer(tokens.tokenizer_path(), 5, special=True)
    assert few.encode(SPECIAL).tolist() == [437, 13, 50256, 10019]
    for own in (few, tokens.ChunkTokenizer(tokens.tokenizer_path(), special=True)):
        ids, counts = own.encode_many([t.encode() for t in texts], 7)
        want = [[*x.ids, 7] for x in whole.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_queries_give_special_ids(spark, tmp_path):
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(1, SPECIAL), (2, "x")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    crc = [zlib.crc32(np.array([437, 13, 50256, 10019, end], "<u4")) for end in (packing.END, token_files.END)]
    packed = {r.doc_id: r for r in queries.op2_packing(spark, folder).collect()}
    assert (packed[1].doc_tokens, packed[1].ids_crc32) == (5, crc[0])
    files = {r.doc_id: r for r in queries.op9_token_files(spark, folder).collect()}
    assert (files[1].n_tokens, files[1].ids_crc32, files[2].start) == (5, crc[1], 5)


def pack_is_right(rows, texts, plain, size=1024):
    want = collections.Counter(len(plain(t)) + 1 for _, t in texts)
    assert collections.Counter(r.doc_tokens for r in rows if r.start == 0) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return by


def test_packing(spark, odd, plain):
    rows = packing.pack_documents(odd).collect()
    pack_is_right(rows, ODD, plain)
    ids = np.array([*plain(ODD[6][1]), 0], "<u4")
    long = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 7)
    assert sum(x[1] for x in long) == len(ids)
    assert all(zlib.crc32(ids[a : a + n]) == c for a, n, c in long)
    assert packing.pack_documents(odd.limit(0)).isEmpty()
    with_ids = packing.token_pieces(odd, keep_ids=True).where("doc_id = 9").first()
    assert with_ids.ids == [*plain(ODD[10][1]), 0]


def test_packing_is_tight(spark, data, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = queries.op2_packing(spark, data).collect()
    by = pack_is_right(rows, docs, plain)
    assert sum(r.length for r in rows) / (1024 * len(by)) > 0.97


def test_shortest_pack_first():
    packs = packing.patterns({700: 2, 300: 3, 100: 5}, 1024)
    assert sum(n * lengths.count(300) for n, lengths in packs) == 3 and sum(n * lengths.count(100) for n, lengths in packs) == 5
    assert all(sum(lengths) <= 1024 for _, lengths in packs)


def one_by_one(histogram, size=1024):
    """What packs have left when each piece goes on the emptiest pack that has room."""
    left = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            most = max(left, default=0)
            if most >= length:
                left.remove(most)
            left.append((most if most >= length else size) - length)
    return sorted(left)


def test_shortest_pack_first_is_piece_by_piece():
    assert sum(n for n, _ in packing.patterns({100: 1000})) == 100
    assert sum(n for n, _ in packing.patterns({500: 999})) == 500
    rng = np.random.default_rng(1)
    cases = [{100: 1000}, {500: 999}, {700: 2, 300: 3, 100: 5}, *({int(k): int(n) for k, n in zip(rng.integers(1, 1025, 12), rng.integers(1, 60, 12))} for _ in range(100))]
    for histogram in cases:
        packs = packing.patterns(histogram)
        assert sorted(x for n, lengths in packs for x in [1024 - sum(lengths)] * n) == one_by_one(histogram), histogram
        assert all(sum(n * lengths.count(k) for n, lengths in packs) == v for k, v in histogram.items())


def test_packing_of_copies_is_tight(spark, data, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    short = "a short text that many rows repeat " * 12
    docs += [(10_000_000 + k, short) for k in range(len(docs) // 2)]
    by = pack_is_right(packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs, plain)
    assert sum(k for pieces in by.values() for _, k in pieces) / (1024 * len(by)) > 0.97


def test_token_files(spark, odd, plain, tmp_path):
    target = "file://" + str(tmp_path / "t")
    token_files.write(odd, target, parts=3)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.digests(spark, target).collect()), key=lambda r: r[2])
    at, ids = 0, []
    for has, i, start, n, _ in got:
        assert start == at
        at += n
        ids.append((has, i))
    assert ids == sorted(ids) and at == sum(len(plain(t)) + 1 for _, t in ODD)
    lists = {r.doc_id: r.ids for r in token_files.documents(spark, target, [2, 9]).collect()}
    assert lists == {2: [*plain(ODD[1][1]), 2], 9: [*plain(ODD[10][1]), 2]}
    token_files.write(odd.limit(0), target + "0", parts=2)
    assert token_files.digests(spark, target + "0").isEmpty()
    crc = zlib.crc32(np.array([*plain("x"), 2], "<u4"))
    assert [r[4] for r in got if r[1] in (6, 8)] == [crc] * 3


# -- 3, 8


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op3_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, odd):
    model = langid.fit(odd.where("doc_id in (1, 2)"), least=1)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[1][0] == got[9][0] == "en" and got[1][1] > 0.9
    none = langid.fit(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model).isEmpty()


def test_letters_and_null_ids(spark, tmp_path):
    assert [langid.has_letter(x.encode()) for x in ("½", "²", "Ⅷ", "1_", "é", "漢", "x")] == [False] * 4 + [True] * 3
    rows = [(None, "some words of a text", "en"), (1, "andere worte im text", "de"), (1, "andere worte im text", "de"), (2, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for q in (queries.op3_language_id, queries.op8_quality):
        got = q(spark, str(tmp_path)).collect()
        assert len(got) == 4 and {r.held_out for r in got if r.doc_id is None} == {False}


def test_language_scores_equal_sets(spark):
    """The filter against exact sets of n-grams: where no n-gram is falsely met, shares are the same."""
    docs = spark.createDataFrame([(k, "alpha beta gamma delta words" if k % 2 else "eins zwei drei vier funf worte", "a" if k % 2 else "b") for k in range(20)], "doc_id long, text string, lang string")
    model = langid.fit(docs, least=1)
    grams = lambda t: langid.grams_of([t.encode()], langid.WIDTH)[0].tolist()
    known = {x: {g for r in docs.where(F.col("lang") == x).collect() for g in grams(r.text)} for x in "ab"}
    texts = ["alpha zwei", "beta gamma", "drei delta drei", "worte"]
    pred, score = model.score([t.encode() for t in texts])
    for t, p, s in zip(texts, pred, score, strict=True):
        hits = {x: sum(g in known[x] for g in grams(t)) for x in "ab"}
        assert p == max("ab", key=lambda x: hits[x]) and abs(s - hits[p] / sum(hits.values())) < 0.02


def test_quality_scores_are_sums_of_table_entries(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = quality.fit(docs.withColumn("label", F.lit(1)).withColumn("share", F.lit(2)).withColumn("_id", F.lit(3)), spark.read.parquet(f"{data}/labels.parquet"), rounds=8)
    rows = docs.limit(40).collect()
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows), model).collect()}
    for r in rows:
        x = quality.features([(r.text or "").encode()])[0]
        at = [int(sum(v >= e for e in edges)) for v, edges in zip(x, model.edges, strict=True)]
        total = model.base + sum(t[k] for t, k in zip(model.tables, at, strict=True)) + sum(g[at[a], at[b]] for (a, b), g in zip(model.pairs, model.grids, strict=True))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-total))) < 1e-9


def test_shards_equal_a_loop(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    slot = {r.doc_id: r.v for r in spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", sharding.virtual_slot().alias("v")).collect()}
    size = {i: len((t or "").encode()) + 16 for i, t in docs}
    load = collections.Counter()
    for i, v in slot.items():
        load[v] += size[i]
    held, number, shard = [0] * 40, [0] * 40, {}
    for v in sorted(range(sharding.SLOTS), key=lambda v: (-load[v], v)):
        s = min(range(40), key=lambda s: (held[s], number[s], s))
        shard[v], held[s], number[s] = s, held[s] + load[v], number[s] + 1
    place = collections.Counter()
    want = []
    for v, i, t in sorted((slot[i], i, t) for i, t in docs):
        want.append((i, size[i], zlib.crc32((t or "").encode()), shard[v], place[shard[v]]))
        place[shard[v]] += 1
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in queries.op6_sharding(spark, data).collect()) == sorted(want)


def test_many_languages():
    names = [f"l{k:03d}" for k in range(130)]
    grams = [np.arange(k * 50, k * 50 + 50, dtype=np.uint64) for k in range(130)]
    f = langid.LanguageFilter(names, grams, [1.0] * 130, 4)
    for k in (0, 64, 129):
        a, b = f._at(grams[k])
        assert (f._bit(f.slots[a] & f.slots[b], k) == 1).all()


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = queries.op8_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").collect()
    right = {q: np.mean([r.predicted == q for r in rows if r.quality == q]) for q in (0, 1)}
    assert right[1] > 0.95 and right[0] > 0.8


def test_quality_odd_rows(spark, odd):
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "doc_id long, quality int")
    for labels in (one, one.limit(0)):
        model = quality.fit(odd, labels)
        assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    assert quality.keep_good(odd, quality.fit(odd, one)).columns == odd.columns
    assert quality.score(odd.limit(0), quality.fit(odd, one)).isEmpty()


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_matrix(x, y, np.ones(4000))
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}


# -- 4


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a.b/c\r\nx", "WARC/1.1\r\n\r\n\r\nContent-Length: 3", 5), (2, None, None, 5), (3, "u", "", 5), (None, "u", "<é>\r\n\r\n", 5), (4, "u", "<é>\r\n\r\n", 5), (6, "https://Www.B.a:80/q?x=1#f", "p" * 200_000, 5), (7, "u", "p" * 200_000, 5), (7, "u", "p" * 200_000, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    target = "file://" + str(tmp_path / "w")
    warc.write(pages, target, records_per_file=2)
    got = warc.read_index(spark, target, 2).collect()
    assert all(r.intact for r in got) and len(got) == len(rows)
    last = {}
    for i, _, h, _ in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = sorted(((i or 0), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if last[h or ""] == i else "revisit", 0 if last[h or ""] == i else last[h or ""]) for i, _, h, _ in rows)
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got) == want
    keys = [(r.url_key, r.ts, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)
    assert warc.url_key("https://Www.B.a:80/q?x=1#f") == "a,b,www)/q?x=1"
    warc.write(pages.limit(0), target + "0")
    assert warc.read_index(spark, target + "0").isEmpty()


def test_archive_of_the_registered_table(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet").collect()
    last = {}
    for r in rows:
        last[r.html or ""] = max(r.page_id, last.get(r.html or "", r.page_id))
    want = []
    for r in rows:
        h, p = (r.html or "").encode(), last[r.html or ""]
        want.append((r.page_id, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if p == r.page_id else "revisit", None if p == r.page_id else p))
    got = queries.op4_warc(spark, data).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_archive_dates_do_not_depend_on_zone_or_size(spark, tmp_path):
    df = spark.createDataFrame([(5, "u", "a"), (10**13, "u", "b"), (-1, "u", "c"), (None, "u", "d"), (None, "u", "d")], "page_id long, url string, html string")
    seen = []
    for k, zone in enumerate(("Asia/Tokyo", "UTC")):
        spark.conf.set("spark.sql.session.timeZone", zone)
        warc.write(df, f"file://{tmp_path}/z{k}")
        seen.append(sorted((r.ts, r.page_id or 0) for r in warc.read_index(spark, f"file://{tmp_path}/z{k}").collect()))
    assert seen[0] == seen[1] and len(seen[0]) == 5 and ("2023-11-14T00:00:05Z", 5) in seen[0] and all(len(t) == 20 for t, _ in seen[0])


def test_loser_tree():
    rng = np.random.default_rng(3)
    for k in range(7):
        runs = [sorted(rng.integers(0, 20, rng.integers(0, 9)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


# -- 5


def brute_components(docs):
    sets = {}
    for k, (_, text) in enumerate(docs):
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UP))
        sets[k] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and label[a] != label[b] and 100 * len(x & y) >= 75 * len(x | y):
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[label[k]] = min(i, least.get(label[k], i))
    return collections.Counter((i, len(sets[k]), least.get(label[k])) for k, (i, _) in enumerate(docs))


def test_jaccard_equals_brute_force(spark, odd):
    rng = np.random.default_rng(5)
    vocab = [f"w{k}" for k in range(400)]
    docs = list(ODD)
    for base in range(6):
        text = rng.choice(vocab, 60).tolist()
        for k in range(12):
            other = list(text)
            for at in rng.choice(60, rng.integers(0, 3), replace=False):
                other[at] = f"new{base}-{k}-{at}"
            docs.append((100 + base * 20 + k, " ".join(other)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs)
    # few buckets, salted lists and large components give the same as the defaults
    for options in ({}, {"list_rows": 3, "group_shingles": 200, "max_buckets": 1 << 10}):
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(df, **options).collect()) == want
    assert jaccard.components(odd.limit(0)).isEmpty()


def test_all_pairs_and_drop(spark, odd):
    base = [f"w{k}" for k in range(50)]
    docs = [(1, " ".join(base)), (2, " ".join([*base, "x"])), (3, " ".join([*base, "y"])), (4, " ".join(base).upper()), (5, "else")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r.doc_a, r.doc_b) for r in jaccard.similar_pairs(df).collect()) == [(1, 2), (1, 3), (2, 3)]
    assert sorted(r.doc_id for r in jaccard.drop_near_copies(df).collect()) == [1, 5]
    same_id = spark.createDataFrame([*docs, (2, "other words that have nothing to do with it"), (None, " ".join([*base, "z"]))], "doc_id long, text string")
    assert sorted((r.doc_id, len(r.text)) for r in jaccard.drop_near_copies(same_id).collect()) == [(1, len(docs[0][1])), (2, 43), (5, 4)]
    clash = odd.withColumn("maybe", F.lit(7)).withColumn("gone_id", F.lit(8)).withColumn("cls", F.lit(9))
    assert jaccard.drop_near_copies(clash).columns == clash.columns
    kept = jaccard.drop_near_copies(odd)
    assert kept.columns == odd.columns and {1, 3, 4, 6, 7, 9, 10, None} <= {r.doc_id for r in kept.collect()}


def test_parities_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
        y = np.unique(np.concatenate([x[: rng.integers(0, 300)], rng.integers(0, 1 << 62, 50).astype(np.uint64)]))
        bound = sum((a ^ b).bit_count() for a, b in zip(jaccard.parities(x), jaccard.parities(y), strict=True))
        assert bound <= len(np.setxor1d(x, y))


def test_shingle_hashes_do_not_depend_on_the_batch():
    texts = [b"a b c d e f", b"", b"  A\tb\nc d e", b"q", b"a b c d e"]
    together = list(shingles.shingle_sets(texts))
    assert [x.tolist() for x in together] == [next(iter(shingles.shingle_sets([t]))).tolist() for t in texts]
    assert together[2].tolist() == together[4].tolist() and len(together[0]) == 2 and len(together[1]) == 0 and len(together[3]) == 1


# -- 6


def test_sharding(spark, odd):
    loads = sharding.slot_bytes(odd, slots=64)
    rows = sharding.assign(odd, sharding.first_map(loads, 4, 64)).collect()
    assert len(rows) == len(ODD)
    for s in range(4):
        mine = sorted(r.slot for r in rows if r.shard == s)
        assert mine == list(range(len(mine)))
    one = next(r for r in rows if r.doc_id == 9)
    assert one.size == len(ODD[10][1].encode()) + 16 and one.text_crc32 == zlib.crc32(ODD[10][1].encode())
    assert sharding.assign(odd.limit(0), sharding.first_map({}, 4, 64)).isEmpty()


def test_shard_sizes_are_near_equal(spark):
    rows = queries.op6_sharding(spark, "/root/testdata/sf0.01").groupBy("shard").agg(F.sum("size").alias("b"), F.max("slot").alias("m"), F.count("*").alias("n")).collect()
    sizes = [r.b for r in rows]
    assert len(rows) == 40 and max(sizes) - min(sizes) < 0.02 * np.mean(sizes) and all(r.m == r.n - 1 for r in rows)


def test_map_edits(spark, tmp_path):
    rng = np.random.default_rng(4)
    loads = {v: int(rng.integers(1, 1000)) for v in range(2000)}
    now = sharding.first_map(loads, 10, 2000)
    more = sharding.grow(now, loads, 10)
    moved = [v for v in range(2000) if now[v] != more[v]]
    assert moved and all(more[v] == 10 for v in moved)
    held = np.bincount(more, [loads[v] for v in range(2000)])
    assert held.max() / held.mean() < 1.05
    drift = {v: b * (5 if now[v] == 0 else 1) for v, b in loads.items()}
    new = sharding.rebalance(now, drift, 10)
    held = np.bincount(new, [drift[v] for v in range(2000)])
    assert held.max() / held.mean() < 1.02 and sum(a != b for a, b in zip(now, new, strict=True)) < 700
    path = "file://" + str(tmp_path / "map")
    sharding.save_map(spark, now, path, 1)
    sharding.save_map(spark, new, path, 2)
    assert sharding.load_map(spark, path) == new and sharding.load_map(spark, path, 1) == now


# -- 7


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a & <b> &lt; </turn><next/>"), (1, 1, "assistant", "x"), (1, 2, "assistant", ""), (1, 3, "assistant", "é\n\\"), (2, 0, None, None), (3, None, "assistant", "z"), (3, 1, "user", "z"), (3, 1, "user", "z"), (None, 0, "ass<istant", "t")]
    long = [(9, k, "assistant" if k % 3 else "user", f"t{k} <") for k in range(1500)]
    df = spark.createDataFrame([(*t, "k") for t in turns + long], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df)
    rows = {r.conv_id: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for c in {t[0] for t in turns + long}:
        mine = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns + long if t[0] == c))
        assert [(b.role, b.text) for b in rows[c].back] == [m[2:] for m in mine]
        assert rows[c].loss == "".join(m[3] for m in mine if m[2] == "assistant")
    assert rows[1].formatted.count("<turn ") == 2
    assert chat.format_conversations(df.limit(0)).isEmpty()


# -- 10


def test_exact_dedup_odd_rows(spark, odd):
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark_copies(odd).collect())
    by = collections.defaultdict(list)
    for i, t in ODD:
        by[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = []
    for group in by.values():
        keep = min(group)[3]
        want += [(g[3] or 0, keep, len(group), g[3] == keep and g[0] == min(group)[0]) for g in group]
    assert got == sorted(want)
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(by)
    assert exact_dedup.mark_copies(odd.limit(0)).isEmpty() and exact_dedup.drop_copies(odd.limit(0)).isEmpty()
    full = exact_dedup.mark_copies(odd, bits_per_row=1, max_bits=1 << 13)
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in full.collect()) == got


# -- pipeline


def test_pipeline(spark, data):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    now = docs
    kept = {}
    for name, stage in C.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, now, data).collect(), docs.schema)
        assert out.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in out.collect()}
        now = out
    copies = {r.doc_id for r in exact_dedup.mark_copies(spark.createDataFrame(list(kept["quality"].items()), "doc_id long, text string")).where("kept").collect()}
    assert set(kept["exact_dedup"]) == copies
    near = brute_components(list(kept["exact_dedup"].items()))
    assert set(kept["near_dedup"]) == {i for i, n, c in near if i == c or n == 0}
    hits = brute_hits(list(kept["near_dedup"].items()), bench)
    assert set(kept["decontamination"]) == {i for i, (n, h, _) in hits.items() if not (h > 0 and 20 * h >= n)}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    gone = [i for i in labels if i not in kept["quality"]]
    assert sum(labels[i] for i in gone) <= 0.1 * len(labels)
    rows = C.run(spark, data).collect()
    assert {r.doc_id for r in rows} == set(kept["decontamination"])
