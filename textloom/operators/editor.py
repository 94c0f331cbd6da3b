"""Editing views over segments: issues, terminology, duplicates, views, statistics, hand-off, migration, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import columns as tc

ISSUE = "array<struct<severity: string, code: string>>"


def filled(c: Column) -> Column:
    return ~tc.is_blank(F.coalesce(c, F.lit("")))


def placeholder_issue(source: Column, target: Column) -> Column:
    """The first issue: another count, another bag, or another order of placeholders; null if there is none."""
    a, b = tc.placeholders(source), tc.placeholders(target)
    return F.when(F.size(a) != F.size(b), "PLACEHOLDER_COUNT_CHANGED").when(F.size(tc.bag_delta(a, b)) > 0, "PLACEHOLDER_MISMATCH").when(a != b, "PLACEHOLDER_ORDER_CHANGED")


def segment_issues(source: Column, target: Column) -> Column:
    """Errors, warnings and hints of a segment; a blank target is silent."""

    def issue(when: Column, severity: str, code: Column) -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), code.alias("code")))

    first = placeholder_issue(source, target)
    typed = target.rlike(r"<<[\s\S]*?>>|\[\[[\s\S]*?\]\]|\$\{") & ~source.rlike(r"<<[\s\S]*?>>|\[\[[\s\S]*?\]\]|\$\{")
    found = F.array(issue(first.isNotNull(), "error", first), issue(typed, "warn", F.lit("UNEXPECTED_STRUCTURE")), issue(source == target, "info", F.lit("SAME_AS_SOURCE")))
    return F.when(filled(target), F.filter(found, lambda x: x.isNotNull())).otherwise(F.array().cast(ISSUE))


def has_blocking(issues: Column) -> Column:
    return F.exists(issues, lambda i: i["severity"].isin("error", "warn"))


def terminology(segments: DataFrame, terms: DataFrame, ignored: DataFrame | None = None, most: int = 10_000) -> DataFrame:
    """(unit_id, term) where a whole word of the source is a glossary term, case and all, and the target lacks its translation.

    Segments meet terms by the words they hold: each term is looked up under its first word, so this is an equi-join; a term of
    several words is verified in the text.  ``ignored`` has (unit_id, term) to leave out.
    """
    t = terms.where(filled(F.col("source"))).select(F.col("source").alias("term"), F.col("target").alias("want"), F.regexp_extract("source", r"^\W*(\w+)", 1).alias("word"))
    s = segments.where(filled(F.col("translation"))).select("unit_id", "source", "translation")
    words = s.select("unit_id", "source", "translation", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(r"(\w+)"), F.lit(1)))).alias("word"))
    if t.limit(most + 1).count() <= most:
        t = F.broadcast(t)
    # \Q...\E quotes the term; a term that holds \E itself is cut and quoted again
    quoted = F.concat(F.lit("\\Q"), F.replace("term", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    whole = F.expr("source RLIKE pattern")
    hits = words.join(t, "word").withColumn("pattern", F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted, F.lit("(?![A-Za-z0-9_])"))).where(whole & ~F.contains("translation", "want"))
    hits = hits.select("unit_id", "term").distinct()
    return hits if ignored is None else hits.join(ignored, ["unit_id", "term"], "left_anti")


def duplicate_groups(segments: DataFrame) -> DataFrame:
    """(source, n, divergent, empty_count, first_id) of sources, not blank, that stand more than once.

    first_id is the least unit id; the members are rows of ``segments`` with that source, so no list grows with a group.
    """
    on = filled(F.col("translation"))
    g = segments.where(filled(F.col("source"))).groupBy("source")
    a = g.agg(F.count("*").alias("n"), F.min(F.when(on, F.col("translation"))).alias("lo"), F.max(F.when(on, F.col("translation"))).alias("hi"), F.count(F.when(~on, 1)).alias("empty_count"), F.min("unit_id").alias("first_id"))
    return a.where("n > 1").select("source", "n", F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("divergent"), "empty_count", "first_id")


def duplicate_fill(segments: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """(unit_id, after) for blank members of a group with one translation, or with a choice (source, chosen)."""
    on = filled(F.col("translation"))
    g = segments.where(filled(F.col("source"))).groupBy("source").agg(F.count("*").alias("n"), F.min(F.when(on, F.col("translation"))).alias("lo"), F.max(F.when(on, F.col("translation"))).alias("hi"))
    g = g.where("n > 1")
    if choices is not None:
        g = g.join(choices, "source", "left")
        after = F.coalesce("chosen", F.when(F.col("lo") == F.col("hi"), F.col("lo")))
    else:
        after = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    rule = g.select("source", after.alias("after")).where("after IS NOT NULL")
    return segments.where(~on).join(rule, "source").select("unit_id", "after")


def view(segments: DataFrame, query: str | None = None, kind: str = "all", sort: str = "original", term: str | None = None, marked: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """Search, then filter, then a stable sort.  Filters: all, todo, done, a status, term, or those in ``marked`` (unit_id): issues, duplicate, conflict."""
    rows = segments
    if query:
        needle = F.lit(query.lower())
        rows = rows.where(F.exists(F.array("unit_id", "passage", "source", "translation"), lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), needle)))
    on = filled(F.col("translation"))
    if kind in ("todo", "done"):
        rows = rows.where(on if kind == "done" else ~on)
    elif kind in ("issues", "duplicate", "conflict"):
        rows = rows.join(marked.select("unit_id").distinct(), "unit_id", "left_semi")
    elif kind == "term":
        rows = rows.where(F.contains("source", F.lit(term)))
    elif kind != "all":
        rows = rows.where(F.col("status") == kind)
    first = {"todo": [on.cast("int")], "passage": [F.col("passage")]}.get(sort, [])
    return rows.orderBy(*first, order)


def status_stats(segments: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """Counts in one row; ``issues`` has unit_id and severity, of which hints don't count."""
    rows = segments
    if issues is not None:
        bad = issues.where("severity != 'info'").select("unit_id", F.lit(True).alias("bad")).distinct()
        rows = rows.join(bad, "unit_id", "left")
    else:
        rows = rows.withColumn("bad", F.lit(None).cast("boolean"))

    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    total, done = F.count("*"), n(filled(F.col("translation")))
    percent = F.when(total > 0, F.floor(done * 100 / total + 0.5)).otherwise(0).cast("long")
    return rows.agg(total.alias("total"), done.alias("translated"), (total - done).alias("untranslated"), percent.alias("percent"), *[n(F.col("status") == s).alias(s) for s in ("proofread", "reviewed", "flagged")], n(F.col("bad")).alias("issues"))


def plan_handoff(current: DataFrame, incoming: DataFrame, mode: str = "fill") -> DataFrame:
    """(unit_id, action, after): change, conflict or identical.  Blanks are filled in all modes; only overwrite replaces."""
    both = current.select("unit_id", "translation").join(incoming.select("unit_id", F.col("translation").alias("new")), "unit_id").where(filled(F.col("new")))
    old = filled(F.col("translation"))
    action = F.when(~old, "change").when(F.col("translation") == F.col("new"), "identical").otherwise("change" if mode == "overwrite" else "conflict")
    return both.select("unit_id", action.alias("action"), F.when(action == "change", F.col("new")).alias("after"))


def plan_migration(old: DataFrame, new: DataFrame) -> DataFrame:
    """(unit_id, outcome): safe, modified, suggestion, ambiguous, added for new segments, deleted for old ones.

    old, new: unit_id, source, translation.  A source that isn't blank and stands once on both sides is a suggestion.
    Sources are only compared, so their sha256 goes through the shuffles in their place.
    """
    digest = F.unhex(F.sha2("source", 256))
    old, new = old.select("unit_id", digest.alias("source"), filled(F.col("source")).alias("on")), new.select("unit_id", digest.alias("source"))
    o = old.select("unit_id", F.col("source").alias("old_source"))
    by_id = new.join(o, "unit_id", "left")
    rest = by_id.where("old_source IS NULL").select("unit_id", "source")
    loose_old = old.join(new.select("unit_id"), "unit_id", "left_anti").where("on")
    n_old = loose_old.groupBy("source").agg(F.count("*").alias("n_old"))
    n_new = rest.groupBy("source").agg(F.count("*").alias("n_new"))
    found = rest.join(n_old, "source", "left").join(n_new, "source", "left")
    outcome = F.when(F.col("n_old").isNull(), "added").when((F.col("n_old") == 1) & (F.col("n_new") == 1), "suggestion").otherwise("ambiguous")
    same = by_id.where("old_source IS NOT NULL").select("unit_id", F.when(F.col("source") == F.col("old_source"), "safe").otherwise("modified").alias("outcome"))
    gone = old.join(new.select("unit_id"), "unit_id", "left_anti").join(n_new.select("source").distinct(), "source", "left_anti").select("unit_id", F.lit("deleted").alias("outcome"))
    return same.unionByName(found.select("unit_id", outcome.alias("outcome"))).unionByName(gone)


def adopt_project(records: DataFrame, segments: DataFrame, statuses: tuple[str, ...] = ("unmarked", "proofread", "reviewed", "flagged")) -> DataFrame:
    """Stored editing records whose unit and source are those of this kit, their status made sound."""
    keep = records.join(segments.select("unit_id", "source"), ["unit_id", "source"], "left_semi")
    return keep.withColumn("status", F.when(F.col("status").isin(*statuses), F.col("status")).otherwise("unmarked"))


def page_window(page: Column, total: Column, size: int = 9) -> tuple[Column, Column]:
    """First and last page of a window of ``size`` around a page, clamped to 1..total."""
    first = F.greatest(F.lit(1), F.least(page - size // 2, total - size + 1))
    return first, F.least(total, first + size - 1)


def apply_events(segments: DataFrame, events: DataFrame) -> DataFrame:
    """Segments after a log of edits (unit_id, ord, translation, undone): the last edit that wasn't undone wins and resets the status."""
    w = Window.partitionBy("unit_id").orderBy(F.desc("ord"))
    last = events.where("NOT undone").withColumn("nth", F.row_number().over(w)).where("nth = 1").select("unit_id", F.col("translation").alias("edited"), F.lit(True).alias("hit"))
    both = segments.join(last, "unit_id", "left")
    hit = F.col("hit").isNotNull()
    return both.withColumn("translation", F.when(hit, F.col("edited")).otherwise(F.col("translation"))).withColumn("status", F.when(hit, "unmarked").otherwise(F.col("status"))).drop("edited", "hit")
