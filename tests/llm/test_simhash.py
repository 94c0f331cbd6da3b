import random

import xxhash

from textloom.llm.simhash import fingerprint_links, simhash, simhash_groups


def brute_print(text, words):
    import re

    found = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())]
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(fps, bits):
    parent = {i: i for i in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def test_fingerprint_matches_its_definition():
    for t in [None, "", " \n\t", "one", "One two", "a b c", "ÀB c d\x1fe f\x0bg ß", "x " * 300]:
        assert simhash(t, 3) == brute_print(t, 3)


def test_spark_uses_the_same_hash(spark):
    r = spark.sql("SELECT xxhash64('a b c') AS h").first().h
    assert r % (1 << 64) == xxhash.xxh64(b"a b c", seed=42).intdigest()


def test_groups_match_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, rows[5][1]), (1004, rows[5][1])]
    rows += [(1100 + i, rows[8][1] + " tail" * i) for i in range(5)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, u int")
    fps = {i: simhash(t, 3) for i, t in rows}
    want = {i: (f"{fps[i]:016x}", c) for i, c in brute_groups(fps, 2).items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_groups(df).collect()} == want


def test_links_join_all_near_fingerprints(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:20]:
        for _ in range(12):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(f)
    fps |= {0, 1 << 63, (1 << 64) - 1}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = fingerprint_links(spark.createDataFrame(signed, "fp long"), 2).collect()
    parent = {f[0]: f[0] for f in signed}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in links:
        assert ((r.u ^ r.v) % (1 << 64)).bit_count() <= 2
        parent[root(r.u)] = root(r.v)
    for a in parent:
        for b in parent:
            if ((a ^ b) % (1 << 64)).bit_count() <= 2:
                assert root(a) == root(b)


def test_empty_table_and_null_ids(spark):
    assert simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "q w e r"), (4, "q w e r"), (None, "zz"), (4, "q w e r")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash_groups(df).collect()) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def test_columns_named_like_inner_ones_change_nothing(spark):
    rows = [(1, "q w e r", 5, 6, "x"), (2, "q w e r", 6, 5, "y"), (3, "other words stand here", 5, 5, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long, component_id long, fingerprint string")
    out = simhash_groups(df)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and sorted(r.component_id for r in out.collect()) == [1, 1, 3]
