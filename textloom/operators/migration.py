"""Records on a new version of a story, records from a localization source, its validation, and alignment of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import columns as tc
from textloom.operators.coverage import first_wins, last_wins


def content_key(source_fp: Column, structure_fp: Column) -> Column:
    return F.concat(F.coalesce(source_fp, F.lit("undefined")), F.lit("|"), F.coalesce(structure_fp, F.lit("undefined")))


def migrate_records(records: DataFrame, units: DataFrame, unit_order: str = "unit_ord") -> DataFrame:
    """(unit_id, new_unit_id, outcome): kept by unit id whatever its text, moved by content key (the last unit wins), changed if its passage is still there, else obsolete.

    units: unit_id, passage, source_fingerprint, structural_fingerprint, unit_ord.
    """
    r = records.select("unit_id", "passage", content_key(F.col("source_fingerprint"), F.col("structural_fingerprint")).alias("key"))
    own = units.select("unit_id", F.lit(True).alias("same")).distinct()
    by_key = last_wins(units.select(content_key(F.col("source_fingerprint"), F.col("structural_fingerprint")).alias("key"), F.col("unit_id").alias("target"), unit_order), "key", unit_order).drop(unit_order)
    there = units.select("passage", F.lit(True).alias("there")).distinct()
    both = r.join(own, "unit_id", "left").join(by_key, "key", "left").join(there, "passage", "left")
    outcome = F.when(F.col("same").isNotNull(), "kept").when(F.col("target").isNotNull(), "moved").when(F.col("there").isNotNull(), "changed").otherwise("obsolete")
    return both.select("unit_id", outcome.alias("outcome"), F.when(outcome == "kept", F.col("unit_id")).when(outcome == "moved", F.col("target")).alias("new_unit_id"))


def migration_report(outcomes: DataFrame, samples: int = 20) -> DataFrame:
    """Counts by outcome and the first ``samples`` moved ids in order."""

    def n(s: str):
        return F.count(F.when(F.col("outcome") == s, 1)).alias(s)

    counts = outcomes.agg(n("kept"), n("moved"), n("changed"), n("obsolete"))
    first = outcomes.where("outcome = 'moved'").orderBy("unit_id").limit(samples).agg(F.array_sort(F.collect_list("unit_id")).alias("moved_sample"))
    return counts.crossJoin(F.broadcast(first))  # one row each


def match_entries(entries: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, unmatched): entries (passage, from_text, to_text) on units by passage and raw text, many to many."""
    u = units.select("unit_id", "passage", F.col("raw_text").alias("from_text"))
    return entries.join(u, ["passage", "from_text"]), entries.join(u, ["passage", "from_text"], "left_anti")


def validate_entries(entries: DataFrame, passages: DataFrame) -> DataFrame:
    """entries (ord, id, passage, from_text, to_text, all_sites, allow) with occurrences, first_pos and error codes.

    allow: array of (code, reason).  The first passage of a name counts.  Hard and structural findings are errors unless allowed.
    """
    names = first_wins(passages.select(F.col("name").alias("passage"), "content", "passage_ord"), "passage", "passage_ord").drop("passage_ord")
    by_id, by_site = Window.partitionBy(F.coalesce("id", F.concat(F.lit("\0"), F.col("ord").cast("string")))).orderBy("ord"), Window.partitionBy("passage", "from_text").orderBy("ord")
    e = entries.withColumn("nth_id", F.row_number().over(by_id)).withColumn("nth_site", F.row_number().over(by_site)).join(names, "passage", "left")
    missing = F.when(F.coalesce("passage", F.lit("")) == "", "missing-passage").when(F.coalesce("from_text", F.lit("")) == "", "missing-from").when(F.coalesce("to_text", F.lit("")) == "", "missing-to")
    # counted once a row, and before Python reads the row, which would be copied with the passage in it
    e = e.select(*entries.columns, "nth_id", "nth_site", F.col("content").isNotNull().alias("known"), tc.occurrences(F.col("content"), F.col("from_text")).alias("n"), (F.instr(F.col("content"), F.col("from_text")) - 1).alias("first"))
    n, known = F.col("n"), F.col("known")
    allowed = F.transform(F.coalesce("allow", F.array().cast("array<struct<code: string, reason: string>>")), lambda a: a["code"])
    live = missing.isNull() & known & (n > 0)
    found = F.filter(tc.tiers(F.when(live, F.col("from_text")), F.when(live, F.col("to_text"))), lambda f: f["tier"].isin("hard", "structural") & ~F.array_contains(allowed, f["code"]))
    errors = F.concat(
        F.array(
            F.when(F.col("id").isNotNull() & (F.col("nth_id") > 1), "duplicate-id"), missing,
            F.when(missing.isNull() & (F.col("nth_site") > 1), "duplicate-passage-from"),
            F.when(missing.isNull() & ~known, "passage-not-found"),
            F.when(missing.isNull() & (n == 0), "from-not-found"),
            F.when(live & (n > 1) & ~F.coalesce("all_sites", F.lit(False)), "occurs-more-than-once"),
            F.when(F.exists(F.coalesce("allow", F.array().cast("array<struct<code: string, reason: string>>")), lambda a: (F.coalesce(a["code"], F.lit("")) == "") | (F.coalesce(a["reason"], F.lit("")) == "")), "allow-incomplete"),
        ),
        F.when(live, F.transform(found, lambda f: F.concat(F.lit("protection-"), f["code"]))).otherwise(F.array().cast("array<string>")),
    )
    return e.select("ord", "id", "passage", "from_text", "to_text", F.when(live, n).alias("occurrences"), F.when(live, F.col("first")).alias("first_pos"), F.filter(errors, lambda x: x.isNotNull()).alias("errors"))


def canonical_body(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"(?U)[\s\x{feff}]+\z", "")


def compiled_body(raw: Column) -> Column:
    """What the compiler makes of a passage's lines: leading blank lines go, and the indent of a body right under its header."""
    body = F.regexp_replace(raw, r"^\n+", "")
    return F.when(raw.startswith("\n"), body).otherwise(F.regexp_replace(body, r"^[ \t]+", ""))


def align_passages(source: DataFrame, target: DataFrame) -> DataFrame:
    """(name, relation) of both versions.  source: name, raw; target: name, content, ord (the first of a name counts)."""
    s = source.select("name", "raw", compiled_body(F.col("raw")).alias("body"), F.lit(True).alias("s"))
    t = first_wins(target.select(tc.decode_entities("name").alias("name"), "content", "ord"), "name", "ord").select("name", "content", F.lit(True).alias("t"))
    both = s.join(t, "name", "full_outer")
    meta = F.col("s").isNotNull() & F.col("name").isin("StoryData", "StoryTitle")
    content = canonical_body(F.col("content"))
    relation = (
        F.when(meta, "metadata").when(F.col("t").isNull(), "source-only").when(F.col("s").isNull(), "target-only")
        .when(content == canonical_body(F.col("raw")), "exact").when(content == canonical_body(F.col("body")), "normalized").otherwise("changed")
    )
    return both.select("name", relation.alias("relation"))


def align_files(source: DataFrame, target: DataFrame, version: str | None = None, placeholder: str = "build version") -> DataFrame:
    """(path, relation) of bundled files: exact, version-substituted, whitespace, changed, source-only, target-only."""
    s = source.select("path", F.replace("content", F.lit("\r\n"), F.lit("\n")).alias("a"), F.lit(True).alias("s"))
    header = r"^/\*[\s\S]*?\*/\r?\n?"
    t = target.where("file IS NOT NULL").select(F.regexp_replace("file", r"[\\/]+", "/").alias("path"), F.replace(F.regexp_replace("content", header, ""), F.lit("\r\n"), F.lit("\n")).alias("b"), F.lit(True).alias("t"))
    both = s.join(t, "path", "full_outer")
    end = r"(?U)[\s\x{feff}]+\z"
    substituted = F.col("b") == F.replace("a", F.lit(placeholder), F.lit(version)) if version is not None else F.lit(False)
    relation = (
        F.when(F.col("t").isNull(), "source-only").when(F.col("s").isNull(), "target-only").when(F.col("a") == F.col("b"), "exact").when(substituted, "version-substituted")
        .when(F.regexp_replace("a", end, "") == F.regexp_replace("b", end, ""), "whitespace").otherwise("changed")
    )
    return both.select("path", relation.alias("relation"))


def fonts_present(fonts: DataFrame, target: DataFrame) -> DataFrame:
    """Fonts by base name: compilers register them without their folder."""
    base = F.substring_index(F.regexp_replace("file", r"[\\/]+", "/"), "/", -1)
    names = target.where("file IS NOT NULL").select(base.alias("basename"), F.lit(True).alias("hit")).distinct()
    return fonts.withColumn("basename", F.substring_index("path", "/", -1)).join(names, "basename", "left").select("path", "basename", F.col("hit").isNotNull().alias("present"))


def passage_relations(target: DataFrame, base: DataFrame) -> DataFrame:
    """(name, relation): target-added, base-identical or target-modified, by text with white space folded."""
    b = base.select("name", F.col("content").alias("base"))
    relation = F.when(F.col("base").isNull(), "target-added").when(tc.fold(F.col("base")) == tc.fold(F.col("content")), "base-identical").otherwise("target-modified")
    return target.join(b, "name", "left").select("name", relation.alias("relation"))


def provenance(rows: DataFrame, base: DataFrame, middle: DataFrame, top: DataFrame, target: DataFrame) -> DataFrame:
    """rows (passage, from_text) with relation over three versions; null where the passage isn't in the top version or doesn't come from it.

    base, middle, top: name, raw; target: name, content.
    """

    def version(df: DataFrame, tag: str) -> DataFrame:
        return df.select(F.col("name").alias("passage"), F.col("raw").alias(f"{tag}_raw"), compiled_body(F.col("raw")).alias(f"{tag}_body"))

    both = rows.join(version(base, "base"), "passage", "left").join(version(middle, "mid"), "passage", "left").join(version(top, "top"), "passage", "left")
    both = both.join(target.select(F.col("name").alias("passage"), "content"), "passage", "left")
    content = canonical_body(F.col("content"))
    traced = (content == canonical_body(F.col("top_raw"))) | (content == canonical_body(F.col("top_body")))
    text_in = F.coalesce(F.contains(tc.fold(F.col("mid_body")), tc.fold(F.col("from_text"))), F.lit(False))
    in_base, in_mid = F.col("base_raw").isNotNull(), F.col("mid_raw").isNotNull()
    same = canonical_body(F.col("base_body")) == canonical_body(F.col("mid_body"))
    relation = F.when(text_in & ~in_base, "upstream-added").when(text_in & same, "base-identical").when(text_in, "upstream-changed").when(~in_mid, "target-added").otherwise("target-modified")
    return both.select("passage", "from_text", F.when(traced, relation).alias("relation"))


def files_by_kind(tree: DataFrame) -> DataFrame:
    """(kind, n) of a source tree's files under game/: passages, scripts, styles, fonts, and all."""
    ext = F.lower(F.substring_index("path", ".", -1))
    kind = F.when(~F.col("path").startswith("game/"), "other").when(ext == "twee", "twee").when(ext == "js", "js").when(ext == "css", "css").when(ext.isin("ttf", "otf", "woff", "woff2"), "fonts").otherwise("other")
    return tree.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
