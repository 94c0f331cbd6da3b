import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline as cp
from textloom.llm.queries import piece_model_path
from textloom.llm.simhash import near_copies, shingle_set, similarity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage, run one after another."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        rows = docs.collect()
        done, _ = cp.written(stage(spark, docs, SF), name)
        out.append((rows, done.collect()))
        docs = done
    return out


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(strip))
    seen = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            seen[key(line)].add(r.doc_id)
    return {r.doc_id: "\n".join(x for x in (r.text or "").split("\n") if not key(x) or len(seen[key(x)]) < 10) for r in rows}


def brute_counts(rows, seed):
    n, by = len(rows), Counter(r.source for r in rows)
    out = Counter()
    for r in rows:
        mean = n / (len(by) * by[r.source])
        parts = max(1, math.ceil(mean / 8))
        for j in range(1, parts + 1):
            u = (int(hashlib.md5(f"{seed}|{r.doc_id}|{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            k, p = 0, math.exp(-mean / parts)
            total = p
            while total < u and k < 63:
                k += 1
                p = p * (mean / parts) / k
                total += p
            out[r.doc_id] += k if total >= u else k + 1
    return out


def test_language_stage_keeps_all_documents_with_a_letter(stages):
    rows, kept = stages[0]
    assert {r.doc_id for r in kept} == {r.doc_id for r in rows if r.text and any(c.isalpha() for c in r.text)}


def test_line_stage(stages):
    rows, kept = stages[1]
    assert {r.doc_id: r.text for r in kept} == brute_lines(rows)
    assert all(r.n_chars == len(r.text) for r in kept)


def test_copies_stage(stages):
    rows, kept = stages[2]
    sets = {r.doc_id: shingle_set(r.text, 5).tobytes() for r in rows}
    holders, near = defaultdict(list), defaultdict(set)
    for i, s in sets.items():
        for h in np.frombuffer(s, "<u4").tolist() or [None]:
            holders[h].append(i)
    for ids in holders.values():
        for i in ids:
            near[i].update(ids)
    links = [(a, b) for a in near for b in near[a] if a < b and similarity(sets[a], sets[b]) >= 0.8]
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    stay, groups = {r.doc_id for r in kept}, defaultdict(set)
    for i in sets:
        groups[find(i)].add(i)
    for g in groups.values():
        assert g & stay, "a group lost all its documents"
    assert {min(g) for g in groups.values()} <= stay
    removable = len(rows) - len(groups)
    print(f"copies stage: {removable - (len(stay) - len(groups))} of {removable} copies found")
    assert stay == {min(g) for g in groups.values()}
    texts = [r.text for r in kept]
    assert len(texts) == len(set(texts))


def test_mix_stage(stages):
    rows, out = stages[3]
    assert Counter(r.doc_id for r in out) == +brute_counts(rows, 1)
    by_id = {r.doc_id: r for r in rows}
    assert all(r == by_id[r.doc_id] for r in out)


def test_token_stage(stages):
    rows, out = stages[4]
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    want = Counter()
    for r in rows:
        ids = lib.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in out) == want


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    assert Counter(tuple(r) for r in cp.run(spark, SF).collect()) == Counter(tuple(r) for r in stages[4][1])


def edge_docs(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (None, "some text here", "en", "s", 14, 3), (3, "some text here", "en", "s", 14, 4), (3, "some text here", "en", "s", 14, 5), (4, long, "en", "t", len(long), 6), (5, long + " tail", "en", None, len(long) + 5, 7), (6, "12 34", "en", "t", 5, 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int")


def test_edge_rows_through_all_stages(spark):
    docs, seen = edge_docs(spark), []
    for name, stage in cp.STAGES:
        docs, _ = cp.written(stage(spark, docs, SF), name)
        seen.append(sorted((r.doc_id or -1) for r in docs.collect()))
    assert seen[0] == [-1, 3, 3, 4, 5] and seen[1] == seen[0] and seen[2] == [3, 4]
    assert set(seen[3]) <= {3, 4} and seen[4] == seen[3]


def test_empty_table_through_all_stages(spark):
    docs = edge_docs(spark).limit(0)
    for name, stage in cp.STAGES:
        docs, _ = cp.written(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_near_copies_keeps_other_columns(spark):
    got = near_copies(edge_docs(spark)).collect()
    assert sorted((r.doc_id or -1, r.fp) for r in got if r.doc_id not in (1, 2))[-2:] == [(4, 6), (6, 8)]
