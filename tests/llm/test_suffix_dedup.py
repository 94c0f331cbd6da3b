import hashlib
import random

import numpy as np

from textloom.llm.suffix_dedup import Batch, SuffixFamily, _masks, suffix_dedup


def brute(rows, length):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - length + 1):
            g = t[p : p + length]
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = True
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_family_levels_grow_geometrically():
    family, seen, rng = SuffixFamily(4), {}, random.Random(1)
    for doc in range(40):
        keys = np.array(["".join(rng.choices("ab", k=4)).encode() for _ in range(rng.randrange(1, 9))], "S4")
        got = family.add(keys, np.full(len(keys), doc))
        for k in keys:
            seen.setdefault(k, doc)
        assert [seen[k] for k in keys] == got.tolist()
    sizes = [len(k) for k, _ in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_matches_brute_force_on_planted_passages(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeéßł ", k=rng.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(6)]
    rows = [(i, " ".join([word() for _ in range(rng.randrange(40))] + rng.choices(shared, k=rng.randrange(3)) + [word()])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x" * 400), (103, "x" * 49), (104, "x" * 3000), (105, rows[3][1]), (106, rows[3][1][1:]), (107, "\0" * 120), (108, "ab\0" * 60), (109, "\0" * 90)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, batch string, bucket int")
    assert result(suffix_dedup(df, 50)) == brute(rows, 50)


def test_matches_brute_force_on_the_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert result(suffix_dedup(df, 50)) == brute(rows, 50)


def test_short_texts_alone(spark):
    rows = [(1, "a"), (2, ""), (3, None)]
    assert result(suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 50)


def test_empty_table_and_null_ids(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, "p" * 60), (1, "p" * 60)], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in suffix_dedup(rows).collect()} == {(None, 60), (1, 0)}


def test_runs_do_not_depend_on_the_order_of_rows(spark):
    """Every step reads its rows anew, in another order; runs are named by their numbers, so these must be the same."""
    rng = random.Random(5)
    rows = [(i // 2, " ".join(rng.choices("alpha beta gamma delta".split(), k=rng.randrange(60)))) for i in range(80)] + [(None, "x" * 90), (2**63 - 1, "y" * 90)]
    want = Batch([r[0] for r in rows], [r[1] for r in rows], 50, 26)
    for _ in range(5):
        rng.shuffle(rows)
        got = Batch([r[0] for r in rows], [r[1] for r in rows], 50, 26)
        assert got.names == want.names and got.raw == want.raw
        for name in ("ids", "owner", "begin", "count", "doc"):
            assert (getattr(got, name) == getattr(want, name)).all()


def test_runs_that_repeat_in_a_batch_are_one_class_and_others_are_not():
    """Classes are told by bytes, whatever their hashes; each stands at its first run."""
    rng = random.Random(8)
    part = [" ".join(rng.choices("alpha beta gamma delta".split(), k=40)) for _ in range(12)]
    x = Batch(range(60), [rng.choice(part) + rng.choice(part) for _ in range(60)], 50, 26)
    pick = np.array(rng.sample(range(len(x.begin)), len(x.begin)))
    run = [x.data[b : b + c + 49].tobytes() for b, c in zip(x.begin[pick], x.count[pick])]
    class_, firsts = x.classes(pick)
    assert [run[i] for i in firsts[class_]] == run and len(firsts) == len(set(run)) < len(run)
    assert (firsts[class_] <= np.arange(len(run))).all() and (np.diff(firsts) > 0).all()


def test_only_windows_that_repeat_are_sorted_as_strings(monkeypatch):
    """The time of a bucket goes into strings; a window that stands once in it needs none."""
    rng = np.random.default_rng(9)
    own, shared = rng.integers(0, 256, (200, 70), np.uint8), rng.integers(0, 256, 60, np.uint8)
    text = np.concatenate([np.concatenate([x, shared, x[::-1]]) for x in own])
    begin, count, docs = np.arange(0, len(text), 200), np.full(200, 31), np.arange(200)
    begin = begin + 75 - 31 + 16  # 31 windows around the passage's start
    sent, add = [], SuffixFamily.add
    monkeypatch.setattr(SuffixFamily, "add", lambda self, keys, of: sent.append(len(keys)) or add(self, keys, of))
    got = _masks(text, begin, count, docs, 50)
    first = {}
    for i, b in enumerate(begin):
        for k in range(31):
            first.setdefault(text[b + k : b + k + 50].tobytes(), i)
    want = [sum(1 << k for k in range(31) if first[text[b + k : b + k + 50].tobytes()] < i) for i, b in enumerate(begin)]
    assert got.tolist() == want and any(want) and sum(sent) < count.sum() / 2
