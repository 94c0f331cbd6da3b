"""What a query costs as its plan shows it: guards and text rules stand there once, not once for each filter and column that reads them."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import columns as tc
from textloom.plans.queries import QUERIES


def plan_of(df):
    name = "spark.sql.debug.maxToStringFields"
    before = df.sparkSession.conf.get(name)
    df.sparkSession.conf.set(name, 10_000)
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        df.sparkSession.conf.set(name, before)


@pytest.mark.parametrize("name,most", [("repair_candidates", 30), ("import_report", 30), ("plan_stats", 45), ("build_plan", 45), ("coverage_counts", 40)])
def test_guard_runs_once_and_rules_are_not_copied(spark, sf_dir, name, most):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert plan.count("_verify(") == 1 and plan.count("regexp_replace(") <= most, (plan.count("_verify("), plan.count("regexp_replace("))


def test_occurrences_are_counted_once(spark, sf_dir):
    plan = plan_of(QUERIES["validate_entries"](spark, sf_dir))
    assert plan.count("replace(content") == 1, plan.count("replace(content")


def test_short_ways_of_text_rules_give_what_the_long_ones_give(spark):
    rng = random.Random(7)
    parts = [" ", "  ", "\t", " ", "﻿", "\u0085", "\n", "a", "B c", "<", "<<", ">>", "<b>", "<!--", "-->", "/*", "*/", "/%", "%/", "&amp;", "&", "#", "⟦1⟧", "⟦", "[[", "]]", "|", '"', "<<script>>", "9", "é"]
    rows = [(None,), ("",)] + [("".join(rng.choices(parts, k=rng.randrange(1, 9))),) for _ in range(3000)]
    x, long = F.col("x"), F.col("x")
    for pattern, by in ((r"<!--[\s\S]*?-->", " "), (r"/\*[\s\S]*?\*/", " "), (r"<<[\s\S]*?>>", tc.MARK * 2), (r"<[^>]+>", " "), (tc.ENTITY, " "), (tc.PLACEHOLDER, tc.MARK * 2)):
        long = F.regexp_replace(long, pattern, by)
    bare = x
    for pattern in (r"/%[\s\S]*?%/", tc.PLACEHOLDER, r"\|[^\]]*\]\]", r"\[\[[^\]]*\]\]", r"<<[\s\S]*?>>", r"<[^>]+>", tc.ENTITY, r'"\s*"[^"]*"\s*>>'):
        bare = F.regexp_replace(bare, pattern, " ")
    pairs = {"normal": (tc.normalize_source(x), tc.fold(long)), "blank": (tc.is_blank(x), F.length(tc.fold(x)) == 0), "identity": (tc.is_identity(x), F.coalesce(x.rlike("<</?script>>") | ~bare.rlike("[A-Za-z]"), F.lit(True)))}
    made = spark.createDataFrame(rows, "x string")
    for name, (short, want) in pairs.items():
        odd = made.where(~short.eqNullSafe(want)).collect()
        assert not odd, (name, odd[:3])


def test_scans_hold_pieces_of_a_batch(spark, monkeypatch):
    """Pages with many tokens come back in many small batches, whatever the size of Spark's, and all of them come back."""
    import pandas as pd

    from textloom.functions.batches import PIECE, pieces
    from textloom.operators import tokens as tk

    text = "<b>word</b> " * 1000
    frame = pd.DataFrame({"k": range(300), "__text": [text, None, ""] * 100})
    made = list(pieces([frame], "__text"))
    assert max(x["__text"].map(lambda t: len(t or "")).sum() for x in made) <= PIECE and list(pd.concat(made)["k"]) == list(range(300)) and len(list(pieces([frame[:1]], "__text", 5))) == 1
    sizes = []

    class Rows:
        dtypes = [("k", "bigint")]

        def select(self, *_):
            return self

        def mapInPandas(self, f, _):
            sizes.extend(len(x) for x in f(iter([frame])))

    monkeypatch.setattr(tk.F, "col", lambda _: pd.Series(dtype=object, name="t"))
    monkeypatch.setattr(pd.Series, "alias", lambda s, _: s, raising=False)
    tk.token_rows(Rows(), "k", "t")
    assert len(sizes) > 2 and sum(sizes) == 100 * 4000


def test_migration_shuffles_no_sources(spark, sf_dir):
    """Sides of joins and groups are dealt out by digests; the text ends where its digest is made."""
    import re

    plan = QUERIES["editor_migration"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    text = [x for x in re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin|HashAggregate)\b[^\n]*", plan) if "raw_text" in x]
    assert "sha2" in plan and not text, text[:2]


def test_fingerprint_of_an_inventory_is_packed_before_one_task_reads_it(spark):
    import hashlib
    import random as r

    from textloom.operators import inventory as inv

    rng = r.Random(3)
    units = [(f"{rng.randrange(50)}:{rng.choice(['a', 'é', chr(0x1F600), 'ﬀ'])}{rng.randrange(9)}", f"t{rng.randrange(5)}") for _ in range(2000)] + [("same", "t")] * 90
    lines = sorted(f"{u}\0{hashlib.sha256(t.encode()).hexdigest()[:24]}".encode() for u, t in units)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 20)
    try:
        made = inv.inventory_fingerprint(spark.createDataFrame(units, "unit_id string, protected_text string").repartition(5))
        assert made.collect()[0][0] == "sha256:" + hashlib.sha256(b"\n".join(lines)).hexdigest()[:32]
        assert "RepartitionByExpression [line" in plan_of(made)
    finally:
        spark.conf.set(name, before)
