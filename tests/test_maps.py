"""Tiles against whole maps; file scans."""

import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from embergrid.operators import spatial as G
from embergrid.plans import QUERIES
from embergrid.sources import records as IO


def frame(spark, maps):
    return spark.createDataFrame([(i, int(r), int(c), int(m[r, c])) for i, m in maps.items() for r in range(m.shape[0]) for c in range(m.shape[1])], "image long, r int, c int, lab int").repartition(3)


def flood(free, starts):
    seen, todo = set(), list(starts)
    while todo:
        i, j = todo.pop()
        if (i, j) in seen or not (0 <= i < free.shape[0] and 0 <= j < free.shape[1]) or not free[i, j]:
            continue
        seen.add((i, j))
        todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    return seen


def maps(seed):
    rng = np.random.default_rng(seed)
    ring = np.zeros((14, 17), int)
    ring[2:12, 2:14] = 1
    ring[4:9, 4:10] = 0
    ring[5:8, 5:8] = 2
    ring[10, 15] = 2
    snake = np.zeros((9, 20), int)
    snake[1::2] = 3
    snake[2::4, -1] = snake[4::4, 0] = 3
    return {1: rng.integers(0, 3, (13, 11)), 2: ring, 3: snake, 4: np.kron(rng.integers(0, 4, (5, 5)), np.ones((3, 3), int)), 5: np.zeros((1, 1), int)}


@pytest.mark.parametrize("tile", [256, 4, 1])
def test_pieces_of_tiles_are_those_of_the_map(spark, tile):
    given = maps(1)
    got = {}
    for r in G.labelled(frame(spark, given), tile).collect():
        got.setdefault((r.image, r.comp), set()).add((r.r, r.c))
    want = set()
    for i, m in given.items():
        left = {(r, c) for r in range(m.shape[0]) for c in range(m.shape[1])}
        while left:
            at = min(left)
            piece = flood(m == m[at], [at])
            left -= piece
            want.add((i, frozenset(piece)))
    assert {(i, frozenset(v)) for (i, _), v in got.items()} == want


@pytest.mark.parametrize("tile", [256, 4])
def test_holes_of_tiles_are_those_of_the_map(spark, tile):
    given = maps(2)
    want = set()
    for i, m in given.items():
        for a in set(m.ravel().tolist()) - {0}:
            free = np.pad(m != a, 1, constant_values=True)
            hole = free.copy()
            hole[tuple(np.array(sorted(flood(free, [(0, 0)]))).T)] = False
            want |= {(i, a, b) for b in set(m.ravel().tolist()) - {0, a} if (hole[1:-1, 1:-1] & (m == b)).sum() > 0.5 * (m == b).sum()}
    assert {tuple(r) for r in G.surrounds(frame(spark, given), tile=tile).collect()} == want and (2, 1, 2) in want


def test_hull_of_row_ends_is_the_hull(spark):
    given = maps(3)
    got = {(r.image, r.lab): r.solidity for r in G.solidity(frame(spark, given)).collect()}
    for i, m in given.items():
        for a in set(m.ravel().tolist()) - {0}:
            cells = [(int(c), int(r)) for r, c in np.argwhere(m == a)]
            hull = G.hull_area(cells)
            assert abs(got[i, a] - (min(1.0, len(cells) / hull) if hull > 0 else 1.0)) < 1e-12


def test_short_files_are_not_opened(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF" + b"x" * 200, "b.pdf": b"html" + b"x" * 200, "c.pdf": b"%PDF", "d.txt": b"%PDF" + b"x" * 300}.items():
        (tmp_path / name).write_bytes(data)
    scan = IO.scan_files(spark, f"file://{tmp_path}", "%PDF", 100, "*.pdf")
    assert sorted((r.path.rsplit("/", 1)[1], r.bytes, r.ok) for r in scan.collect()) == [("a.pdf", 204, True), ("b.pdf", 204, False)]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(length,100)" in plan.split("PushedFilters", 1)[1].splitlines()[0].replace(" ", "")


@pytest.mark.parametrize("known", [True, False])
def test_files_of_rows(spark, tmp_path, monkeypatch, known):
    """Files in few folders, without a folder and a rename for each; a store that Arrow does not know gets them by Spark's writer."""
    if not known:
        monkeypatch.setattr(IO.fs, "FileSystem", SimpleNamespace(from_uri=lambda path: spark_only(path)))
    rows = [(k, "é" * k) for k in range(25)] + [(25, None), (-3, "a\nb")]
    IO.write_files(spark.createDataFrame(rows, "k long, body string").coalesce(1), f"file://{tmp_path}/files", "k", "body")
    got = {int(re.search("k=(-?[0-9]+)", r.path)[1]): (r.bytes, r.ok) for r in IO.scan_files(spark, f"file://{tmp_path}/files", "é", 1).collect()}
    assert got == {k: (len(b.encode()) + 1, b.startswith("é")) for k, b in rows if b is not None}
    folders = [p for p in (tmp_path / "files").iterdir() if p.is_dir()]
    assert len(folders) == (1 if known else 26)


def spark_only(path):
    raise pa.ArrowInvalid(f"Unrecognized filesystem type in URI: {path}")


def test_pages_of_one_number_are_files_of_their_own(spark, tmp_path):
    """They were lines of one file."""
    spark.createDataFrame([(3, "x" * 2000), (3, "y" * 3000), (4, "z" * 1998), (5, "é" * 1000), (6, None)], "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in QUERIES["q_file_scan"](spark, str(tmp_path)).collect())
    assert got == [(3, 2006, True), (3, 3006, True), (5, 2001, False)]


def test_large_maps_cluster_like_small_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(i, r, c, [float(x) for x in rng.normal(size=3) + 2 * ((r // 4 + c // 5) % 2)]) for i, (h, w) in {1: (9, 12), 2: (6, 5), 3: (1, 4)}.items() for r in range(h) for c in range(w)]
    df = spark.createDataFrame(rows, "image long, r int, c int, token array<double>").repartition(3)
    whole, dealt, both = (sorted(tuple(x) for x in G.clustered(df, 6, rounds=5, map_cells=m).collect()) for m in (1000, 0, 40))
    assert whole == dealt == both and len(whole) == len(rows)
