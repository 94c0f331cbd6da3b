import math

import numpy as np

from textloom.llm import lattice_dedup as ld
from textloom.llm.lattice_dedup import lattice_dedup, nearest_e8


def brute(rows, cosine):
    vec = []
    for i, v, lab in rows:
        ok = lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        vec.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(n):
        for b in range(a + 1, n):
            if vec[a] is not None and vec[b] is not None and rows[a][2] == rows[b][2] and len(vec[a]) == len(vec[b]) and vec[a] @ vec[b] >= cosine:
                links[a] += 1
                links[b] += 1
                root[find(b)] = find(a)
    least = {}
    for k in range(n):
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return sorted((rows[k][0], links[k], least[find(k)], rows[k][0] == least[find(k)]) for k in range(n))


def planted(seed, n=150, dims=64, noise=0.03):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rng.standard_normal(dims)
        base /= np.linalg.norm(base)
        for k in range(int(rng.integers(1, 5))):
            v = base + rng.standard_normal(dims) * noise * rng.random() * (k > 0)
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], int(i % 3)))
    rows += [(len(rows) + k, rows[7][1], rows[7][2]) for k in range(20)]
    return rows


def got(spark, rows):
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "vec_id long, embedding array<float>, label int, w int, key string")
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice_dedup(df).collect())


def test_decoder_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(1)
    x = rng.random((500, 8)) * 6 - 3
    p = nearest_e8(x)
    d = ((x - p) ** 2).sum(1)
    assert (d <= 1 + 1e-9).all()  # the covering radius of E8 is 1
    for r in ld._roots():
        assert (((x - p - r) ** 2).sum(1) >= d - 1e-9).all()
    both = np.concatenate([p, 2 * p], 0)
    assert np.array_equal(nearest_e8(both), both)


def test_links_and_components_match_brute_force(spark):
    rows = planted(1)
    assert got(spark, rows) == brute(rows, 0.93)


def test_large_cells_are_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(64)
    rows = planted(2, 20) + [(1000 + k, [float(x) for x in (base + rng.standard_normal(64) * 0.12).astype(np.float32)], 1) for k in range(60)]
    monkeypatch.setattr(ld, "BLOCK", 8)
    assert got(spark, rows) == brute(rows, 0.93)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = ld._unit(rng.standard_normal((3000, 64)))
    o = rng.standard_normal((3000, 64))
    o = ld._unit(o - (o * a).sum(1)[:, None] * a)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * o
    (own_a, probed_a), (own_b, probed_b) = (ld.cells(x, ["x"] * 3000) for x in (a, b))
    met = (own_a == own_b) | (own_a[:, :, None] == probed_b).any(2) | (own_b[:, :, None] == probed_a).any(2)
    assert met.any(1).mean() >= 0.98


def test_edge_rows(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e, 1), (2, e, 1), (3, e, 2), (4, e, None), (5, None, 1), (6, [], 1), (7, [0.0] * 3, 1), (8, [1.0, None, 0.0], 1), (9, [1.0, float("nan"), 0.0], 1), (10, [float("inf"), 0.0, 0.0], 1), (11, [2.0, 0.1, 0.0], 1), (12, [1.0, 0.0], 1), (13, [-1.0, 0.0, 0.0], 1)]
    assert got(spark, rows) == brute(rows, 0.93)
    repeated = got(spark, [(1, e, 1), (1, e, 1), (0, [0.0, 1.0, 0.0], 1)])
    assert repeated == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True)]
    assert got(spark, []) == []


def test_long_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((3, 6_000))
    rows = [(i, (base[i % 3] + 0.05 * (i // 3) * rng.standard_normal(6_000)).tolist(), 1, "k", 2.5, "g") for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key string, w double, gid string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ld.lattice_dedup(df).collect()}
    assert got == {i: (1, i % 3) for i in range(6)}
