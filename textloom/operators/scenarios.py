"""Scenario registry and results of rendered passages: shape checks, verdicts, summary, text leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import columns as tc
from textloom.operators.coverage import last_wins


def some(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def problems() -> Column:
    """Problem strings of a scenario row: id, tier, label, passage, overlay, require, expect_target, forbid_source, blocked, interaction, prelude."""

    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    def bare(c: str) -> Column:
        return F.coalesce(F.size(c) <= 0, F.lit(True))

    live = ~F.coalesce("blocked", F.lit(False))
    a, c = F.coalesce(F.col("tier") == "A", F.lit(False)), F.coalesce(F.col("tier") == "C", F.lit(False))
    search = F.coalesce(F.col("interaction.kind") == "search", F.lit(False))
    return some(
        F.when(blank("id"), "missing id"),
        F.when(~a & ~c, F.concat(F.lit("bad tier "), F.coalesce("tier", F.lit("undefined")))),
        F.when(blank("label"), "missing label"),
        F.when(blank("passage") & blank("overlay"), "needs passage or overlay"),
        F.when(bare("require"), "missing require[]"),
        F.when(a & live & bare("expect_target"), "tier A needs expectTargetAny[]"),
        F.when(a & live & F.col("forbid_source").isNull(), "tier A needs forbidSourceAny[]"),
        F.when(c & live & (F.col("expect_target").isNotNull() | F.col("forbid_source").isNotNull()), "tier C must not assert translated text"),
        F.when(search & (F.coalesce("interaction.input", F.lit("")).eqNullSafe("") | F.coalesce("interaction.value", F.lit("")).eqNullSafe("")), "search interaction needs input + value"),
        F.when(F.exists("prelude", lambda p: ~F.coalesce(p, F.lit("")).startswith("<<")), "prelude must be an array of <<widget>> strings"),
    )


def level(scenarios: DataFrame, wanted: DataFrame) -> DataFrame:
    """Scenarios of a level (ord, id), in its order."""
    return wanted.join(scenarios, "id").orderBy("ord")


def covered_passages(scenarios: DataFrame) -> DataFrame:
    return scenarios.where(~F.coalesce("blocked", F.lit(False)) & (F.coalesce("passage", F.lit("")) != "")).select("passage").distinct()


def blocked(scenarios: DataFrame) -> DataFrame:
    return scenarios.where(F.coalesce("blocked", F.lit(False))).select("id", "passage")


def visible_errors(packed: Column, base: Column) -> tuple[Column, Column]:
    """(introduced, pre-existing) errors of a rendered passage against those without the pack, in order; null without a baseline."""
    known = lambda e: F.array_contains(base, e)
    return F.filter(packed, lambda e: ~known(e)), F.filter(packed, known)


def verdicts(scenarios: DataFrame, results: DataFrame) -> DataFrame:
    """(id, tier, ok, failures, text_length); the last result of a scenario counts.

    results: id, ord, fatal, error, body_errors, after_errors, require_missing, introduced, leaks (array of names), target_found,
    source_present, overlay (open, content_length, name), interaction (error, applied, narrowed), text_length.
    """
    r = last_wins(results, "id", "ord").withColumnRenamed("overlay", "shown").withColumnRenamed("interaction", "done").withColumn("has", F.lit(True))
    both = scenarios.join(r, "id", "left")
    join = lambda c: F.array_join(c, "|")
    full = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    fatal, error = F.nullif("fatal", F.lit("")), F.nullif("error", F.lit(""))
    over = F.coalesce("overlay", F.lit("")) != ""
    gone = F.col("shown").isNull()
    kind = F.col("interaction.kind")
    failed = F.nullif("done.error", F.lit(""))
    rules = some(
        fatal, F.when(fatal.isNull(), error),
        F.when(F.col("body_errors") > 0, F.concat(F.lit("js-errors:"), "body_errors")),
        F.when(F.col("after_errors") > 0, F.concat(F.lit("js-errors-after-interaction:"), "after_errors")),
        F.when(full("require_missing"), F.concat(F.lit("missing-selectors:"), join("require_missing"))),
        F.when(full("introduced"), F.concat(F.lit("visible-error-introduced:"), join("introduced"))),
        *[F.when(F.coalesce(F.array_contains("leaks", k), F.lit(False)), f"leak:{k}") for k in ("rawMacro", "placeholder", "unresolvedLink", "entityNoise", "templateLiteral")],
        F.when((F.col("tier") == "A") & ~full("target_found"), "no-expected-target-text"),
        F.when((F.col("tier") == "A") & full("source_present"), F.concat(F.lit("source-still-present:"), join("source_present"))),
        F.when(over & gone, "overlay-not-found"),
        F.when(over & ~gone & ~F.coalesce("shown.open", F.lit(False)), "overlay-not-open"),
        F.when(over & ~gone & ~F.coalesce(F.col("shown.content_length") > 0, F.lit(False)), "overlay-empty"),
        F.when(over & (F.coalesce("shown.name", F.lit("")) != "") & (F.col("shown.name") != F.col("overlay")), F.concat(F.lit("overlay-mismatch:"), "shown.name")),
        F.when(kind.isin("search", "endcombat") & failed.isNotNull(), F.concat(F.lit("interaction-error:"), failed)),
        F.when((kind == "search") & failed.isNull() & ~F.coalesce("done.applied", F.lit(False)), "interaction-not-applied"),
        F.when((kind == "search") & failed.isNull() & F.col("done.applied") & (F.col("done.narrowed") == F.lit(False)), "filter-did-not-narrow"),
    )
    failures = F.when(F.col("has").isNull(), F.array(F.lit("no-result"))).otherwise(rules)
    return both.select("id", "tier", failures.alias("failures"), F.coalesce("text_length", F.lit(0)).alias("text_length")).withColumn("ok", F.size("failures") == 0)


def summary(checked: DataFrame) -> DataFrame:
    """(tier, total, passed, max_text_length)."""
    return checked.groupBy("tier").agg(F.count("*").alias("total"), F.count(F.when(F.col("ok"), 1)).alias("passed"), F.max("text_length").alias("max_text_length"))


def unmet_expectations(expected: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, needle) of expected needles (id, passage, needle) that no text (passage, text) of the same passage holds."""
    hit = expected.join(texts, "passage").where(F.contains("text", "needle")).select("id", "needle").distinct()
    return expected.select("id", "needle").join(hit, ["id", "needle"], "left_anti")


def same_lists(before: Column, after: Column) -> Column:
    """struct(comparable, same): two lists of names, kept before and after a run, with the same names in the same order; a null list can't be compared."""
    there = before.isNotNull() & after.isNotNull()
    return F.struct(there.alias("comparable"), (there & F.coalesce(before == after, F.lit(False))).alias("same"))


def leaks(c: Column) -> Column:
    rules = (("rawMacro", r"<<[^>]*?>>"), ("placeholder", tc.PLACEHOLDER), ("unresolvedLink", r"\[\[|\]\]"), ("entityNoise", "&lt;&lt;|&amp;lt;|&amp;gt;"), ("templateLiteral", r"\$\{[^}]*\}"), ("dollarVariable", r"\$[A-Za-z_]"))
    return some(*[F.when(c.rlike(p), k) for k, p in rules])


def diagnostics(c: Column) -> Column:
    """Characters, those beyond ASCII, letters and words of a rendered text."""
    odd = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    words = F.regexp_count(c, F.lit(r"[^\s]+"))
    return F.struct(F.length(c).alias("chars"), odd.alias("non_ascii"), F.length(F.regexp_replace(c, r"[^\p{L}]", "")).alias("letters"), words.alias("words"))
