"""Patch plans: one grouped task per passage, and the cheap decisions as relational operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import columns as tc
from textloom.functions import patching as pt

ROW = (
    "passage string, what string, unit_id string, reason string, detail string, from_text string, to_text string, all_sites boolean, raw_from string, anchored boolean, "
    "left_growth int, right_growth int, span_start int, span_end int, patch_start int, patch_end int, covers array<struct<start: int, end: int>>, covers_units array<string>, is_cluster boolean"
)
BUCKET_PASSAGES = 2000
_NAMES = [x.strip().split(" ")[0] for x in ROW.replace("array<struct<start: int, end: int>>", "a").split(",")]


def build_plan(units: DataFrame, passages: DataFrame, growth: int = pt.GROWTH, clusters: bool = True, whole: bool = False) -> DataFrame:
    """Rows of ``ROW``: what is entry, skipped, covered (reason: how, detail: by which entry), stat (reason: name, detail: value) or failure (reason: code).

    units: passage, unit_id, start_offset, end_offset, raw_text, placeholders, translation (protected or raw).  A unit whose passage
    is missing is skipped; of passages with one name any one counts.  A passage is planned in one task, as its entries depend on each other;
    passages run in parallel, in buckets of a hash of their name, so that many short ones share a call.
    """
    texts = passages.select(F.col("name").alias("passage"), "content")
    rows = units.select("passage", "unit_id", "start_offset", "end_offset", "raw_text", tc.restore(F.coalesce("translation", F.lit("")), F.coalesce("placeholders", F.array().cast(tc.MARKS_TYPE))).alias("to"))

    def plan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        content: dict[str, str] = {}
        for name, text in zip(right["passage"], right["content"]):
            content.setdefault(name, text or "")
        whole_number = lambda v: None if v is None or v != v else int(v)
        groups: dict[str, list[dict]] = {}
        for p, u, a, b, r, t in zip(*(left[c] for c in ("passage", "unit_id", "start_offset", "end_offset", "raw_text", "to"))):
            groups.setdefault(p, []).append({"unit_id": u, "start_offset": whole_number(a), "end_offset": whole_number(b), "raw_text": r, "to": t})
        out: list[dict] = []
        for p, group in groups.items():
            if p not in content:
                out += [{"passage": p, "what": "skipped", "unit_id": u["unit_id"], "reason": "passage-missing"} for u in group]
                continue
            made = pt.plan_passage(content[p], group, growth, clusters, whole)
            for e in made.entries:
                out.append({
                    "passage": p, "what": "entry", "unit_id": e.unit, "from_text": e.frm, "to_text": e.to, "all_sites": e.all, "raw_from": e.raw, "anchored": e.grown is not None,
                    "left_growth": (e.grown or (0, 0))[0], "right_growth": (e.grown or (0, 0))[1], "span_start": e.span[0], "span_end": e.span[1], "patch_start": e.patch[0], "patch_end": e.patch[1],
                    "covers": [{"start": a, "end": b} for a, b in e.covers], "covers_units": e.units, "is_cluster": e.cluster,
                })
            out += [{"passage": p, "what": "skipped", "unit_id": u, "reason": r, "detail": d} for u, r, d in made.skipped]
            out += [{"passage": p, "what": "covered", "unit_id": u, "reason": how, "detail": by} for u, (by, how) in made.covered.items()]
            out += [{"passage": p, "what": "stat", "reason": k, "detail": str(v)} for k, v in made.stats.items() if v]
            out += [{"passage": p, "what": "failure", "unit_id": u, "reason": c} for c, u in pt.failures(content[p], made.entries)]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in out], dtype=object) for n in _NAMES})

    total = passages.count()  # one number: buckets follow the passages, so a call's frame stays small
    n = max(8 * int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_PASSAGES))
    bucket = F.pmod(F.xxhash64("passage"), F.lit(n)).alias("bucket")
    rows, texts = rows.select("*", bucket), texts.select("*", bucket)
    return rows.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInPandas(plan, ROW)


def replayed(plan: DataFrame, passages: DataFrame) -> DataFrame:
    """(passage, text) after a plan's entries, made one after another as their consumer does: the first occurrence, or all."""
    entries = plan.where("what = 'entry'").groupBy("passage").agg(F.array_sort(F.collect_list(F.struct("patch_start", "patch_end", "from_text", "to_text", "all_sites"))).alias("entries"))
    both = passages.select(F.col("name").alias("passage"), "content").join(entries, "passage", "left")
    made = F.aggregate("entries", F.col("content"), lambda text, e: F.when(e["all_sites"], F.replace(text, e["from_text"], e["to_text"])).otherwise(tc.replace_first(text, e["from_text"], e["to_text"])))
    return both.select("passage", F.when(F.col("entries").isNull(), F.col("content")).otherwise(made).alias("text"))


def entry_failures(entries: DataFrame, passages: DataFrame) -> DataFrame:
    """(passage, code, unit_id) of what is wrong with entries (passage, unit_id, from_text, to_text, all_sites, raw_from, span_start, span_end, covers)
    as a passage's list of patches; codes of a whole passage have a blank unit."""
    texts = passages.groupBy(F.col("name").alias("passage")).agg(F.first("content").alias("content"), F.lit(True).alias("known"))
    lists = entries.groupBy("passage").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", "unit_id", "from_text", "to_text", "all_sites", "raw_from", "covers"))).alias("list"))

    @F.pandas_udf("array<struct<code: string, unit_id: string>>")
    def check(content: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for text, rows in zip(content, lists):
            made = [pt.Entry(r["unit_id"], r["from_text"], r["to_text"], (r["span_start"], r["span_end"]), (r["span_start"], r["span_end"]), [(c["start"], c["end"]) for c in r["covers"]], [r["unit_id"]], [], r["raw_from"], bool(r["all_sites"])) for r in rows]
            out.append([{"code": c, "unit_id": u} for c, u in pt.failures(text if isinstance(text, str) else None, made)])
        return pd.Series(out, dtype=object)

    both = lists.join(texts, "passage", "left").withColumn("content", F.when(F.col("known"), F.coalesce("content", F.lit(""))))
    return both.select("passage", F.explode(check("content", "list")).alias("f")).select("passage", "f.code", "f.unit_id")


def plan_stats(plan: DataFrame) -> DataFrame:
    """(name, n): the planner's counters summed over passages."""
    return plan.where("what = 'stat'").groupBy(F.col("reason").alias("name")).agg(F.sum(F.col("detail").cast("long")).alias("n"))


def failures_by_code(plan: DataFrame) -> DataFrame:
    """(code, n) of what is wrong with a plan; no rows if it is sound."""
    return plan.where("what = 'failure'").groupBy(F.col("reason").alias("code")).agg(F.count("*").alias("n"))


def uniform_groups(units: DataFrame, passages: DataFrame) -> DataFrame:
    """(passage, from_text, sites, to_text) that one replace-all entry settles: same text, same translation, and no occurrence that is no unit."""
    g = units.groupBy("passage", F.col("raw_text").alias("from_text")).agg(F.count("*").alias("sites"), F.min("translation").alias("to_text"), F.max("translation").alias("other"))
    both = g.where((F.col("sites") > 1) & F.col("to_text").eqNullSafe(F.col("other"))).join(passages.select(F.col("name").alias("passage"), "content"), "passage")
    return both.where(tc.occurrences(F.col("content"), F.col("from_text")) == F.col("sites")).select("passage", "from_text", "sites", "to_text")


def overlaps(spans: DataFrame) -> DataFrame:
    """Spans (passage, unit_id, start_offset, end_offset) that start before the one before them ends."""
    w = Window.partitionBy("passage").orderBy("start_offset", "end_offset", "unit_id")
    rows = spans.withColumn("before", F.lag("unit_id").over(w)).withColumn("before_end", F.lag("end_offset").over(w))
    return rows.where("start_offset < before_end").select("passage", F.col("before").alias("a"), F.col("unit_id").alias("b"))


def splice(spans: DataFrame, passages: DataFrame) -> DataFrame:
    """(passage, text) with disjoint edits (start_offset, end_offset, to_text) made, from the last to the first."""
    edits = spans.groupBy("passage").agg(F.sort_array(F.collect_list(F.struct("start_offset", "end_offset", "to_text")), asc=False).alias("edits"))
    both = passages.select(F.col("name").alias("passage"), "content").join(edits, "passage", "left")
    none = F.array().cast("array<struct<start_offset: int, end_offset: int, to_text: string>>")
    cut = lambda text, e: F.concat(F.substr(text, F.lit(1), e["start_offset"]), e["to_text"], F.substr(text, e["end_offset"] + 1))
    return both.select("passage", F.aggregate(F.coalesce(F.col("edits").cast("array<struct<start_offset: int, end_offset: int, to_text: string>>"), none), F.col("content"), cut).alias("text"))
