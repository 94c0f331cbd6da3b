import math

import numpy as np
from pyspark.sql import functions as F

from textloom.llm import mtree_search as ms
from textloom.llm.mtree_search import MTree, mtree_search
from textloom.llm.queries import op10_mtree_search


def brute(rows, step, k):
    sound = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            sound[i] = [math.floor(64 * float(x)) for x in v]
    out = []
    for q in sound:
        if q % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(sound[q], sound[c])), c) for c in sound if c != q and len(sound[c]) == len(sound[q]))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def got(df, step, k):
    return sorted(tuple(r) for r in mtree_search(df, F.col("vec_id") % step == 0, k).collect())


def test_tree_is_exact_and_prunes_clustered_data():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16)) * 40
    x = np.floor(centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 16)))
    tree = MTree(x, np.arange(3000))
    for q in range(0, 3000, 100):
        scores = x @ x[q]
        want = [i for i in np.lexsort((np.arange(3000), -scores)) if i != q][:20]
        tree.computed = 0
        ids, got_scores = tree.search(x[q], q, 20)
        assert ids.tolist() == want and got_scores.tolist() == scores[want].tolist()
        assert tree.computed < 1500


def test_covering_radii_and_parent_distances():
    rng = np.random.default_rng(2)
    x = np.floor(rng.standard_normal((1000, 8)) * 20)
    tree = MTree(x, np.arange(1000))

    def walk(page, centre):
        if page.pages is None:
            rows = page.rows
            assert np.allclose(page.to_centre, np.linalg.norm(tree.lifted[rows] - centre, axis=1), atol=1e-4)
            return rows
        every = []
        for c, r, d, p in zip(page.centres, page.radii, page.to_centre, page.pages):
            rows = walk(p, c)
            assert (np.linalg.norm(tree.lifted[rows] - c, axis=1) <= r + 1e-4).all() and abs(d - np.linalg.norm(c - centre)) < 1e-4
            every.append(rows)
        return np.concatenate(every)

    assert sorted(walk(tree.root, tree.centre)) == list(range(1000))


def test_query_over_the_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op10_mtree_search(spark, sf_dir).collect()) == brute(rows, 20, 20)


def test_blocks_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ms, "CANDIDATES", 40)
    monkeypatch.setattr(ms, "QUERIES", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 64]) for i in range(200)] + [(i, [1 / 64, 0.0, 0.0, 0.0]) for i in range(200, 300)]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "vec_id long, embedding array<double>, rank int, block string")
    assert got(df, 5, 6) == brute(rows, 5, 6)


def test_edge_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [0.0, 0.0]), (7, [3e8, -3e8]), (8, [1.0, 2.0, 3.0]), (9, [-1e-9, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(df, 1, 3) == brute(rows, 1, 3)
    assert got(df.limit(0), 1, 3) == []
    huge = spark.createDataFrame([(1, [1e30]), (2, [-1e30]), (None, [1.0])], "vec_id long, embedding array<double>")
    assert got(huge.where("vec_id = 1").union(huge.where("vec_id IS NULL")), 1, 3) == [(1, 1, None, 2**63 - 1)]
    assert got(huge, 2, 3)[0][:2] == (2, 1)


def test_rows_that_repeat_the_querys_id_leave_room_for_others(spark):
    rows = [(0, [1.0, 2.0])] * 25 + [(i, [1.0, 2.0]) for i in range(1, 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = mtree_search(df, F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(1, 21))


def test_components_beyond_double_and_long_vectors(spark):
    """Every finite vector takes part; scores are held at the limits of long."""
    rows = [(0, [1.0, 1.0]), (1, [1e308, 0.0]), (2, [-1e308, 0.0]), (3, [1e200, 1.0]), (4, [2.0, 0.0]), (5, None), (6, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r["rank"], r.score) for r in mtree_search(df, F.col("vec_id") == 0, k=9).collect()}
    top, low = 2**63 - 1, -(2**63)
    assert got == {1: (1, top), 3: (2, top), 4: (3, 64 * 128), 2: (4, low)}
    rng = np.random.default_rng(4)
    long = rng.standard_normal((6, 20_000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(long)], "vec_id long, embedding array<double>")
    whole = np.floor(64 * long).astype(np.int64)
    want = sorted(((int(whole[0] @ whole[j]), j) for j in range(1, 6)), key=lambda x: (-x[0], x[1]))
    assert [(r.score, r.vec_id) for r in mtree_search(df, F.col("vec_id") == 0, k=5).orderBy("rank").collect()] == want


def test_queries_side_by_side_find_what_each_finds_alone():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 16)) * 40
    for x in (np.floor(centres[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 16))), np.floor(rng.standard_normal((3000, 16)) * 3)):
        tree = MTree(x, np.arange(3000))
        asked = np.concatenate([x[::50], x[:1] * 1e200])
        own = np.append(np.arange(0, 3000, 50), 7)
        of, ids, scores = tree.search_all(asked, own, 20)
        for n, q in enumerate(asked):
            want_ids, want_scores = tree.search(q, int(own[n]), 20)
            assert ids[of == n].tolist() == want_ids.tolist() and scores[of == n].tolist() == want_scores.tolist()
