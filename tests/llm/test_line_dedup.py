from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm.line_dedup import line_bitmaps, line_dedup


def brute(rows, min_docs, min_chars=1):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if len(key(x)) < min_chars or len(seen[key(x)]) < min_docs]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


ROWS = [
    (1, "Same\nown one\n\nÉtat\n same \t"), (2, "SAME\r\nown two\nétat"), (3, None), (4, ""), (5, "same"), (6, "same\nsame\n"), (None, "same\nnull id"), (None, "same\nother null"),
    (7, "long " * 3), (8, "long " * 3), (9, "\xa0same"), (9, "\xa0same"), (9, "same\nagain"), (10, "\n\n\n"),
]


@pytest.mark.parametrize("min_docs, min_chars", [(2, 1), (3, 1), (2, 5), (100, 1)])
def test_matches_brute_force(spark, min_docs, min_chars):
    df = spark.createDataFrame([(*r, 1, "w") for r in ROWS], "doc_id long, text string, row int, words string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup(df, min_docs, min_chars, report=True).collect()), key=str)
    assert got == brute(ROWS, min_docs, min_chars)


def test_long_texts_span_many_words_of_the_bitmap(spark):
    rows = [(i, "\n".join("hot" if k % 7 == i % 2 else f"line {i} {k}" for k in range(5000))) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup(df, 3, report=True).collect()), key=str) == brute(rows, 3)
    bits = line_bitmaps(df, 3)
    assert {r.doc_id: r.n for r in bits.select("doc_id", F.expr("aggregate(words, 0L, (a, x) -> a + bit_count(x))").alias("n")).collect()} == {r.doc_id: r.n_dropped for r in bits.collect()}


def test_a_line_of_most_documents_and_other_columns(spark):
    rows = [(i, f"hot line\nown {i}", f"s{i}") for i in range(400)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string, n_dropped string"), 10)
    assert out.columns == ["doc_id", "text", "n_dropped"] and sorted((r.doc_id, r.text, r.n_dropped) for r in out.collect()) == [(i, f"own {i}", f"s{i}") for i in range(400)]


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string"), report=True).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
