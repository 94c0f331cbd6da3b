import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from textloom.llm import mixing
from textloom.llm.mixing import mix_sources


def brute(rows, weights=None, size=None, seed=1):
    by = Counter(s for _, s in rows)
    w = {s: (1.0 if weights is None else float(weights.get(s, 0.0))) for s in by}
    whole, out = sum(w.values()), Counter()
    for i, s in rows:
        mean = w[s] * (size or len(rows)) / (whole * by[s]) if whole else 0.0
        for j in range(1, max(1, math.ceil(mean / 8)) + 1):
            u = (int(hashlib.md5(f"{seed}|{'null' if i is None else i}|{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            lam, k = mean / max(1, math.ceil(mean / 8)), 0
            p = total = math.exp(-lam)
            while total < u and k < 63:
                k += 1
                p = p * lam / k
                total += p
            out[i, s] += k
    return +out


ROWS = [(i, "big") for i in range(300)] + [(i, "mid") for i in range(300, 330)] + [(330, "one"), (331, None), (332, None), (None, "mid"), (333, "")]


def counts(df):
    return Counter((r.doc_id, r.source) for r in df.collect())


@pytest.mark.parametrize("weights, size", [(None, None), ({"one": 0.2, "big": 0.5, "absent": 9.0}, None), ({None: 1.0}, 50), (None, 3000)])
def test_counts_match_brute_force(spark, weights, size):
    df = spark.createDataFrame([(*r, "t", 3) for r in ROWS], "doc_id long, source string, text string, mean int")
    assert counts(mix_sources(df, weights, size)) == brute(ROWS, weights, size)


def test_copies_are_numbered_and_columns_pass(spark):
    df = spark.createDataFrame([(1, "a", "x", 7)], "doc_id long, source string, text string, cdf int")
    rows = mix_sources(df, size=40).collect()
    assert sorted(r["copy"] for r in rows) == list(range(1, len(rows) + 1)) and {(r.text, r.cdf) for r in rows} == {("x", 7)}
    assert mix_sources(df, size=40, copy_col=None).columns == df.columns


def test_shares_come_near_the_targets(spark):
    df = spark.range(40_000).selectExpr("id AS doc_id", "if(id % 10 < 7, 'a', if(id % 10 < 9, 'b', 'c')) AS source")
    got = Counter(r.source for r in mix_sources(df, {"a": 1, "b": 1, "c": 2}).select("source").collect())
    assert np.allclose([got[s] / 40_000 for s in "abc"], [0.25, 0.25, 0.5], atol=0.02)


def test_the_order_mixes_sources(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "if(id < 1000, 'a', 'b') AS source")
    got = [r.source for r in mix_sources(df).collect()]
    assert 300 < sum(a != b for a, b in zip(got, got[1:])) and got == [r.source for r in mix_sources(df).collect()]


def test_many_sources_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 2)
    assert counts(mix_sources(spark.createDataFrame(ROWS, "doc_id long, source string"))) == brute(ROWS)


def test_weights_that_leave_nothing_and_empty_tables(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, source string")
    assert mix_sources(df, {"absent": 1.0}).count() == 0 and mix_sources(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, "a"), (5, "a"), (6, "a")], "doc_id long, source string")
    assert counts(mix_sources(twice, size=9))[5, "a"] == 2 * brute([(5, "a"), (7, "a"), (6, "a")], size=9)[5, "a"]


def test_no_python_in_the_plan(spark, sf_dir):
    plan = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
