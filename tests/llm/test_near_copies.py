import random
from itertools import combinations

import numpy as np

from textloom.llm.simhash import near_copies, shingle_set, simhash, similarity


def words(rng, n):
    return [f"x{rng.randrange(10**9)}" for _ in range(n)]


def left(spark, rows):
    return {r.doc_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def copies_left(spark, pairs):
    """How many copies stay of pairs (text, near copy), none of which is like another pair."""
    stay = left(spark, [(2 * i + j, " ".join(t)) for i, p in enumerate(pairs) for j, t in enumerate(p)])
    assert stay >= set(range(0, 2 * len(pairs), 2))
    return len(stay) - len(pairs)


def test_all_pairs_of_a_crowded_bucket_are_compared(spark):
    """Texts that share a passage have near fingerprints; each one's copy must be found among all the others."""
    rng = random.Random(11)
    passage, pairs = words(rng, 200), []
    for _ in range(300):
        own = passage + words(rng, 45)
        pairs.append((own, own + words(rng, 12)))
    assert copies_left(spark, pairs) <= 5


def test_texts_of_one_fingerprint_are_compared_with_each_other(spark):
    """One passage repeated many times decides the fingerprint; the distinct bodies decide the similarity."""
    rng = random.Random(12)
    passage, pairs = words(rng, 5) * 400, []
    for _ in range(40):
        own = passage + words(rng, 100)
        pairs.append((own, own + words(rng, 5)))
    assert copies_left(spark, pairs) == 0


def similarity_of(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_block_edits_and_appended_passages_are_found(spark):
    """Pairs at similarity 0.8 to 0.9: one passage replaced, or one appended."""
    rng, pairs = random.Random(13), []
    while len(pairs) < 300:
        own, n = words(rng, 300), rng.randrange(14, 30)
        at = rng.randrange(300 - n)
        copy = own[:at] + words(rng, n) + own[at + n :] if len(pairs) % 2 else own + words(rng, rng.randrange(34, 72))
        if 0.8 <= similarity_of(own, copy) <= 0.9:
            pairs.append((own, copy))
    assert copies_left(spark, pairs) == 0


def test_no_near_copy_of_the_given_documents_is_missed(spark):
    """Recall over near copies alone: exact copies are taken out first."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").dropna().dropDuplicates(["text"]).collect()
    sets = {r.doc_id: shingle_set(r.text, 5).tobytes() for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        if 4 * len(sets[a]) <= 5 * len(sets[b]) and 4 * len(sets[b]) <= 5 * len(sets[a]) and similarity(sets[a], sets[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {find(i) for i in sets}
    assert len(want) < len(sets)
    assert left(spark, [tuple(r) for r in rows]) == want


def test_large_buckets_are_cut_into_pairs_of_blocks(spark, monkeypatch):
    """Buckets beyond a block: a dense group, and members that are like few others; no link is lost."""
    import textloom.llm.simhash as sh

    rng = random.Random(21)
    base = words(rng, 120)
    texts = []
    for _ in range(150):
        t = list(base)
        for _ in range(rng.randrange(1, 12)):
            t[rng.randrange(len(t))] = words(rng, 1)[0]
        texts.append(t)
    texts += [base + words(rng, rng.randrange(10, 90)) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: shingle_set(t, 5).tobytes() for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        if similarity(sets[a], sets[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {find(i) for i in sets}
    real, seen = sh._verified, []
    for block, rounds in ((16, 0), (16, 6), (1024, 6)):
        monkeypatch.setattr(sh, "HUB_ROUNDS", rounds)
        monkeypatch.setattr(sh, "_verified", lambda shared, sketches, least, block=block: real(shared, sketches, least, block))
        seen.append(left(spark, rows))
    assert seen == [want] * 3


def test_hubs_of_components_do_not_change_them(spark, monkeypatch):
    from textloom.llm import components as co

    rng = random.Random(3)
    pairs = [(0, i) for i in range(1, 400)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(300)] + [(5, 950), (950, 951)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    want = {tuple(r) for r in co.components(edges)[0].collect()}
    monkeypatch.setattr(co, "MAX_BROADCAST", 0)
    monkeypatch.setattr(co, "HUBS", 20)
    assert {tuple(r) for r in co.components(edges)[0].collect()} == want
    assert {u for u, v in want if v == 0} == {*range(1, 400), 950, 951}


def slight_copies(rng, n):
    """Pairs so near that their fingerprints lie within two bits."""
    pairs = []
    while len(pairs) < n:
        own = words(rng, 400)
        copy = [*own, *words(rng, 1)]
        if (simhash(" ".join(own), 5) ^ simhash(" ".join(copy), 5)).bit_count() <= 2:
            pairs.append((own, copy))
    return pairs


def test_fingerprints_alone_find_the_copies_in_their_reach(spark, monkeypatch):
    """The named method is a step of its own: without any band, texts meet by their fingerprints, and the exact similarity decides."""
    import textloom.llm.simhash as sh

    rng = random.Random(31)
    pairs, passage = slight_copies(rng, 30), words(rng, 5) * 400
    pairs += [(own, own + words(rng, 2)) for own in (passage + words(rng, 100) for _ in range(10))]  # alike by fingerprint, unlike by their sets
    monkeypatch.setattr(sh, "min_hashes", lambda hashes: np.zeros(0, np.int64))
    assert copies_left(spark, pairs) == 0


def test_bands_that_fingerprints_have_settled_are_closed(spark, monkeypatch):
    import textloom.llm.simhash as sh

    rng, real, seen = random.Random(32), sh._verified, []
    pairs = slight_copies(rng, 20)
    monkeypatch.setattr(sh, "_verified", lambda shared, sketches, least: seen.append(shared.select("key").distinct().count()) or real(shared, sketches, least))
    assert copies_left(spark, pairs) == 0
    base = words(rng, 200)
    assert copies_left(spark, pairs + [(base, base[:180] + words(rng, 15))]) == 0  # far beyond two bits: a band's part
    assert seen == [40, 0, 40, 2]
