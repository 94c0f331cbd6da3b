"""Queries over built markup whose answer SQL can state: scanner, guard, sources and sinks, planner.

Each benchmark item fills templates: §t stands for its words and §n for its number.  The same templates give the text in Spark and in SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import columns as tc
from textloom.operators import inventory as inv
from textloom.operators import kit
from textloom.operators import planner as pl
from textloom.operators import scenarios as sc
from textloom.operators import tokens as tk
from textloom.plans.base import RECORDS, UNITS, records, table, units
from textloom.plans.queries import query
from textloom.sources import archive as ar
from textloom.sources import records as rec
from textloom.sources import story as st
from textloom.sources.shared import new_path

ITEMS = "items AS (SELECT item_id, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS t FROM benchmark)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")).alias("t"))


def _pieces(template: str) -> list[str]:
    return [p for p in re.split("(§t|§n)", template) if p]


def filled(template: str) -> Column:
    return F.concat(F.lit(""), *[F.col("t") if p == "§t" else F.col("item_id").cast("string") if p == "§n" else F.lit(p) for p in _pieces(template)])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled_sql(template: str) -> str:
    return "(" + " || ".join(["''", *("t" if p == "§t" else "item_id::VARCHAR" if p == "§n" else _quoted(p) for p in _pieces(template))]) + ")"


def by_case(templates: list[str | None]) -> Column:
    """The template of the item's case; cases take turns."""
    out = F.lit(None).cast("string")
    for k, x in enumerate(templates):
        out = F.when(F.col("item_id") % len(templates) == k, F.lit(None).cast("string") if x is None else filled(x)).otherwise(out)
    return out


def by_case_sql(values: list[str | None]) -> str:
    return f"CASE item_id % {len(values)} " + " ".join(f"WHEN {k} THEN {'NULL' if x is None else filled_sql(x)}" for k, x in enumerate(values)) + " END"


def passages(rows: DataFrame, content: Column) -> DataFrame:
    item = F.col("item_id")
    return rows.select(item.alias("passage_ord"), item.cast("int").alias("pid"), F.concat(F.lit("item "), item.cast("string")).alias("name"), F.array().cast("array<string>").alias("tags"), content.alias("content"), F.lit(0).cast("long").alias("content_offset"))


# Scanner --------------------------------------------------------------------------------------------------------------

TOKENS = [
    ("comment", "<!-- §t -->"),
    ("macro", '<<set $x to "a>>§t">>'),
    ("text", "§t"),
    ("link", "[[Go §t|Room §n]]"),
    ("text", " and "),
    ("html", '<b class="x>y§n">'),
    ("html", "&amp;"),
    ("text", " §t "),
    ("variable", "$var§n"),
    ("comment", "/* §t */"),
    ("code", '<<script>>var s = "<</script>>"; // §t\n<</script>>'),
    ("variable", '${fn({a: "}§t"})}'),
    ("text", " end"),
]


def _token_sql() -> str:
    rows, before = [], ""
    for n, (kind, template) in enumerate(TOKENS):
        rows.append(f"SELECT item_id, {n} AS ord, '{kind}' AS kind, length({filled_sql(before)})::INT AS start_at, length({filled_sql(before + template)})::INT AS end_at FROM items")
        before += template
    return f"WITH {ITEMS} " + " UNION ALL ".join(rows)


@query(_token_sql())
def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of token, with ends of others inside of strings, scripts and holes."""
    rows = items(spark, sf_dir).select("item_id", filled("".join(x for _, x in TOKENS)).alias("content"))
    return tk.token_rows(rows, "item_id", "content").select("item_id", "ord", "kind", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(f"""WITH {ITEMS}, d AS (SELECT item_id, item_id % 4 AS a, item_id % 5 + 1 AS b FROM items)
           SELECT item_id, a::INT AS ord, a::INT AS depth FROM d UNION ALL SELECT item_id, (a + b + 1)::INT, greatest(0, a - b)::INT FROM d UNION ALL SELECT item_id, (a + b + 3)::INT, (greatest(0, a - b) + 1)::INT FROM d""")
def nesting_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts among more or fewer closings than openings: the depth never falls below 0."""
    n = F.col("item_id")
    content = F.concat(F.repeat(F.lit("<<if $a>>"), (n % 4).cast("int")), "t", F.repeat(F.lit("<<endif>>"), (n % 5 + 1).cast("int")), F.lit(" tail<<for $i>> end"))
    return tk.depth_rows(items(spark, sf_dir).select("item_id", content.alias("content")), "item_id", "content").where("kind = 'text'").select("item_id", "ord", "depth")


CODE = [
    ('<<set $text to "Say §t.">>', "passage_text", "code-string", "js-double", "Say §t."),
    ("<<run show({title: 'Title §t', id: \"Hidden Id §n.\"})>>", "passage_text", "code-string", "js-single", "Title §t"),
    ("<<link [[Walk §t|Room §n]]>><</link>>", "link_label", "macro-link-label", "link", "Walk §t"),
    ('<<button "Press §t">>-<</button>>', "macro_label", "macro-label", "arg-double", "Press §t"),
    ('<<print "Shown §t">>', "passage_text", "code-string", "js-double", "Shown §t"),
    ('<<if $a is "Decided §t.">>-<</if>>', None, None, None, None),
    ("[[Go §t|Room §n]]", "link_label", "link-markup", "link", "Go §t"),
    ('<<script>>alert(`Told §t.`);<</script>>', "passage_text", "code-string", "js-template", "Told §t."),
]


@query(f"WITH {ITEMS} " + " UNION ALL ".join(f"SELECT item_id, '{k}' AS kind, '{o}' AS origin, '{c}' AS context, {filled_sql(x)} AS raw_text, length({filled_sql(''.join(y[0] for y in CODE[:n]) + part[: part.index(x)])})::INT AS start_offset FROM items" for n, (part, k, o, c, x) in enumerate(CODE) if x))
def code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of code, labels of links and macros that are exported, beside strings that are decided on or looked up."""
    scanned = inv.scan_passages(passages(items(spark, sf_dir), filled("".join(x[0] for x in CODE))))
    return scanned.select(F.col("passage_ord").alias("item_id"), F.explode("scan.units").alias("u")).select("item_id", "u.kind", "u.origin", "u.context", "u.raw_text", "u.start_offset")


ISSUES = ["Left << over §t", "<<script>>var x = 1; // §t", '<<set $x to "open §t>>', '<<goto "Some Place §t">>']


@query(f"""WITH {ITEMS}, g AS (SELECT item_id % 4 AS k, count(*) AS n, min(item_id) AS first FROM items GROUP BY k)
           SELECT CASE k WHEN 0 THEN 'passage-text-unparsed' WHEN 1 THEN 'code-block-unterminated' WHEN 2 THEN 'macro-scan-fallback' ELSE 'unexported-code-string' END AS code,
                  CASE k WHEN 0 THEN 'text' WHEN 3 THEN 'goto' ELSE '' END AS host, 'item ' || first AS passage, CASE k WHEN 3 THEN 8 ELSE 0 END AS "offset", n AS "count" FROM g""")
def issue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left-over markup, blocks and strings without an end, strings of naming macros: by code and host, with the first place of each."""
    return inv.issues(inv.scan_passages(passages(items(spark, sf_dir), by_case(ISSUES)))).select("code", "host", "passage", "offset", "count")


@query(f"WITH {ITEMS} SELECT item_id, 'open:div|open:b|self:br|close:b|close:div' AS tags FROM items")
def html_tag_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", F.array_join(tc.tags(filled('<div class="x">§t<B id=a>§t<br/></B></div>')), "|").alias("tags"))


# Guard ----------------------------------------------------------------------------------------------------------------

PAIRS = [
    ("§t $x", "§t", "V3_VARIABLE_CHANGED"),
    ("§t [[Go|A]]", "§t [[Go|B]]", "V3_LINK_TARGET_CHANGED"),
    ("§t <b>x</b>", "§t x", "V3_HTML_NESTING_CHANGED"),
    ("<<if $a>>§t<<else>>U<</if>>", "<<if $a>>§t<</if>>", "V3_COND_BRANCH_COUNT_CHANGED"),
    ("<<if $a>>§t<</if>>", "<<if $b>>§t<</if>>", "V3_COND_EXPR_CHANGED"),
    ("<<if $a>>§t<</if>>", "<<if $a>>§t", "V3_MACRO_BALANCE_CHANGED"),
    ("<<he>> §t", "§t", ""),
    ("§t ${a}", "§t ${b}", "V3_TEMPLATE_EXPR_CHANGED"),
    ("§t", " ", "EMPTY_TRANSLATION"),
    ("§t", "§t", "NO_OP"),
    ("<<if $a>>x<<elseif $b>>y<<else>>§t<</if>>", "<<if $a>>x<<else>>y<<elseif $b>>§t<</if>>", "V3_COND_EXPR_CHANGED|V3_COND_ORDER_CHANGED"),
    ("<<if $a>><<if $b>>§t<</if>><</if>>", "<<if $a>>§t<</if>><<if $b>><</if>>", "V3_COND_NESTING_CHANGED"),
    ("<<foo>> §t", "<<bar>> §t", "V3_MACRO_NAME_CHANGED"),
    ("<<if $a>><<he>>§t<<else>>§t<</if>>", "<<if $a>>§t<<else>><<he>>§t<</if>>", "V3_PRONOUN_MACRO_MOVED_ACROSS_BRANCH"),
    ("<<their>> §t", "§t", "V3_PRONOUN_MACRO_REMOVED"),
    ("§t", "§t `", "TEXT_BACKTICK_UNBALANCED"),
]


@query(f"WITH {ITEMS} SELECT item_id, {by_case_sql([x[2] for x in PAIRS])} AS codes FROM items")
def guard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair for each thing that a translation must not change, and one with an omission that it may."""
    found = tc.verify(by_case([x[0] for x in PAIRS]), by_case([x[1] for x in PAIRS]))
    return items(spark, sf_dir).select("item_id", F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["code"]))), "|").alias("codes"))


MARKED = [
    ("⟦0⟧ §t x ⟦1⟧", "<<he>> §t x $x", ""),
    ("§t x ⟦1⟧", "§t x $x", ""),
    ("⟦0⟧ §t x", "<<he>> §t x", "PLACEHOLDER_MISMATCH|PLACEHOLDER_ORDER_CHANGED|V3_VARIABLE_CHANGED"),
    ("⟦1⟧ §t x ⟦0⟧", "$x §t x <<he>>", "PLACEHOLDER_ORDER_CHANGED"),
    ("⟦0⟧ §t x ⟦1⟧ ⟦7⟧", "<<he>> §t x $x ⟦7⟧", "PLACEHOLDER_ADDED"),
    ("⟦0⟧ §t x ⟦1⟧", "<<he>> §t y $x", "REVERSIBLE_MISMATCH"),
    ("⟦0⟧ ⟦0⟧ §t x ⟦1⟧", "<<he>> <<he>> §t x $x", "PLACEHOLDER_MISMATCH|PLACEHOLDER_ORDER_CHANGED"),
]


@query(f"WITH {ITEMS} SELECT item_id, {by_case_sql([x[2] for x in MARKED])} AS codes FROM items")
def relaxed_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of pronouns may go; others stay, once each and in order."""
    marks = F.array(*[F.struct(F.lit(f"⟦{n}⟧").alias("placeholder"), F.lit(raw).alias("raw"), F.lit(k).alias("kind"), F.lit(name).cast("string").alias("name")) for n, (raw, k, name) in enumerate((("<<he>>", "macro", "he"), ("$x", "variable", None)))])
    found = tc.verify(filled("<<he>> §t $x"), by_case([x[1] for x in MARKED]), None, filled("⟦0⟧ §t ⟦1⟧"), by_case([x[0] for x in MARKED]), marks)
    return items(spark, sf_dir).select("item_id", F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["code"]))), "|").alias("codes"))


TIERS = [
    ("§t $x", "§t", "HARD_VARIABLE_CHANGED"),
    ("§t ${a}", "§t", "HARD_TEMPLATE_HOLE_CHANGED"),
    ("§t %d", "§t", "HARD_PRINTF_CHANGED"),
    ("§t [[Go|A]]", "§t [[Go|B]]", "HARD_LINK_TARGET_CHANGED"),
    ("<<if gone>>§t<</if>>", "<<if here>>§t<</if>>", "HARD_CONDITION_CHANGED"),
    ("<<wait 3>>§t", "<<wait 4>>§t", "HARD_CONTROL_MACRO_ARG_CHANGED"),
    ('<b id="a">§t</b>', '<b id="b">§t</b>', "HARD_HTML_ATTR_CHANGED"),
    ("<<for a>>§t<<endfor>>", "<<for a>>§t", "STRUCT_BLOCK_SEQUENCE_CHANGED|STRUCT_MACRO_NAME_CHANGED"),
    ("<b>§t</b>", "<i>§t</i>", "STRUCT_HTML_CHANGED"),
    ("<<foo>>§t", "<<bar>>§t", "STRUCT_MACRO_NAME_CHANGED"),
    ("<<he>> §t", "<<she>> §t", "SOFT_PRONOUN_MACRO_CHANGED"),
    ('<b title="a">§t</b>', "<b>§t</b>", "MANUAL_HTML_ATTR_REVIEW"),
    ("§t", "§t x", ""),
]


@query(f"WITH {ITEMS} SELECT item_id, {by_case_sql([x[2] for x in TIERS])} AS codes FROM items")
def tier_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tc.tiers(by_case([x[0] for x in TIERS]), by_case([x[1] for x in TIERS]))
    return items(spark, sf_dir).select("item_id", F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["code"]))), "|").alias("codes"))


@query(f"""WITH {ITEMS}, c AS (SELECT item_id % {len(TIERS)} AS k FROM items)
           SELECT count(*) AS checked, count(*) FILTER (WHERE k = 12) AS clean, count(*) FILTER (WHERE k <> 12) AS with_findings, count(*) FILTER (WHERE k < 7) AS hard_entries,
                  count(*) FILTER (WHERE k IN (7, 8, 9)) AS structural_entries, count(*) FILTER (WHERE k = 10) AS soft_entries, count(*) FILTER (WHERE k = 11) AS manual_entries FROM c""")
def analyze_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = items(spark, sf_dir).select(F.col("item_id").cast("string").alias("where_"), F.lit(0).alias("pos"), by_case([x[0] for x in TIERS]).alias("source"), by_case([x[1] for x in TIERS]).alias("target"))
    return tk.analyze_pairs(pairs)[0].select("checked", "clean", "with_findings", "hard_entries", "structural_entries", "soft_entries", "manual_entries")


@query(f"""WITH {ITEMS}, c AS (SELECT item_id, {by_case_sql([x[2] for x in TIERS])} AS codes FROM items) SELECT code, count(*) AS n FROM (SELECT unnest(string_split(codes, '|')) AS code FROM c WHERE codes <> '') GROUP BY code""")
def tier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = items(spark, sf_dir).select(F.col("item_id").cast("string").alias("where_"), F.lit(0).alias("pos"), by_case([x[0] for x in TIERS]).alias("source"), by_case([x[1] for x in TIERS]).alias("target"))
    return tk.analyze_pairs(pairs)[1].groupBy("code").agg(F.sum("n").alias("n"))


# Sources and sinks ----------------------------------------------------------------------------------------------------

STORY = (
    '<html><tw-storydata name="S §n" startnode="1"><style type="text/twine-css" id="twine-user-stylesheet">p{}</style>'
    '<script type="text/twine-javascript" id="twine-user-script">/* twine-user-script #1: "a.js" */var a; <tw-passagedata pid="9" name="no"></tw-passagedata>/* twine-user-script #2: "b.js" */var b = "§t";</script>'
    '<tw-passagedata pid="1" name="P §n" tags="x y" position="1,2">Say &lt;&lt;he&gt;&gt; §t</tw-passagedata><tw-passagedata pid="2" name="Q &amp; §n" tags="">&quot;§t&quot;</tw-passagedata></tw-storydata></html>'
)
PARTS = [
    ("story", None, None, ""),
    ("style", None, "p{}", ""),
    ("script", "a.js", '/* twine-user-script #1: "a.js" */var a; <tw-passagedata pid="9" name="no"></tw-passagedata>', ""),
    ("script", "b.js", '/* twine-user-script #2: "b.js" */var b = "§t";', ""),
    ("passage", "P §n", "Say <<he>> §t", "x|y"),
    ("passage", "Q &amp; §n", '"§t"', ""),
]


@query(f"WITH {ITEMS} " + " UNION ALL ".join(f"SELECT item_id::VARCHAR AS path, '{p}' AS part, {n}::BIGINT AS ord, {'NULL' if a is None else filled_sql(a)} AS name, {'NULL' if c is None else filled_sql(c)} AS content, '{t}' AS tags, sha256({filled_sql(STORY)}) AS sha256 FROM items" for n, (p, a, c, t) in enumerate(PARTS)))
def story_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A story for each item: attributes, bundled scripts and styles, passages outside of them only."""
    files = items(spark, sf_dir).select(F.col("item_id").cast("string").alias("path"), filled(STORY).alias("text"))
    return st.stories(files).select("path", "part", "ord", "name", "content", F.coalesce(F.array_join("tags", "|"), F.lit("")).alias("tags"), "sha256")


@query(f"""WITH {ITEMS} SELECT item_id::VARCHAR AS path, part, kind, id, type, position FROM items, (VALUES ('story', NULL, NULL, NULL, NULL), ('style', 'style', 'twine-user-stylesheet', 'text/twine-css', NULL), ('script', 'script', 'twine-user-script', 'text/twine-javascript', NULL),
           ('script', 'script', 'twine-user-script', 'text/twine-javascript', NULL), ('passage', NULL, NULL, NULL, '1,2'), ('passage', NULL, NULL, NULL, NULL)) AS p(part, kind, id, type, position)""")
def story_plain_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = items(spark, sf_dir).select(F.col("item_id").cast("string").alias("path"), filled(STORY).alias("text"))
    return st.plain_view(st.stories(files)).select("path", "part", "kind", "id", "type", "position")


@query("SELECT conv_id, turn, regexp_matches(text, '[A-Za-z]{3,}') AND (regexp_matches(text, '[A-Za-z]{2,}[ \t][A-Za-z]{2,}') OR regexp_matches(text, '\\b[A-Za-z]{4,}\\b')) AS english FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, -1 - turn, regexp_replace(text, '[aeiou ]', '-', 'g') FROM conversations)")
def plain_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain readers' test, over turns as they are and over turns whose words are cut into pieces."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    rows = c.unionByName(c.select("conv_id", (-1 - F.col("turn")).alias("turn"), F.regexp_replace("text", "[aeiou ]", "-").alias("text")))
    return rows.select("conv_id", "turn", tc.shows_english(F.col("text")).alias("english"))


@query("""WITH l AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id), p AS (SELECT a.conv_id, a.roles AS x, b.roles AS y FROM l a LEFT JOIN l b ON b.conv_id = a.conv_id + 1)
          SELECT conv_id, y IS NOT NULL AS comparable, coalesce(x = y, FALSE) AS same FROM p""")
def list_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's roles against the next one's."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    both = rows.join(rows.select((F.col("conv_id") - 1).alias("conv_id"), F.col("roles").alias("after")), "conv_id", "left")
    return both.select("conv_id", sc.same_lists(F.col("roles"), F.col("after")).alias("c")).select("conv_id", "c.comparable", "c.same")


@query(f"WITH {RECORDS} SELECT unit_id, passage, translation, source_fingerprint FROM records")
def state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as lines of a state, written to the shared folder and read again."""
    path = new_path(spark, "state")
    rows = records(spark, sf_dir, units(table(spark, sf_dir, "documents")))
    rec.write_state(rows.select(F.col("unit_id").alias("unitId"), "passage", "translation", F.col("source_fingerprint").alias("sourceFingerprint")), path)
    return rec.read_state(spark, path).select(F.col("unitId").alias("unit_id"), "passage", "translation", F.col("sourceFingerprint").alias("source_fingerprint"))


LOCAL = [
    '[{"id": "e§n", "passage": "P §n", "from": "§t", "to": "§t zz", "all": true}]',
    '{"entries": [{"passage": "P §n", "from": "§t", "to": "x"}]}',
    '{"typeB": {"TypeBInputStoryScript": [{"pN": "P §n", "f": "§t", "t": "y", "all": false}]}}',
    '{"passage": "P §n", "from": "§t", "to": "z"}\n\n{"passage": "Q §n", "from": "§n", "to": "§t"}',
]


@query(f"""WITH {ITEMS} SELECT item_id::VARCHAR AS file, 0::BIGINT AS ord, CASE item_id % 4 WHEN 0 THEN 'e' || item_id END AS id, 'P ' || item_id AS passage, t AS from_text, {by_case_sql(['§t zz', 'x', 'y', 'z'])} AS to_text, CASE item_id % 4 WHEN 0 THEN TRUE WHEN 2 THEN FALSE END AS all_sites FROM items
           UNION ALL SELECT item_id::VARCHAR, 1, NULL, 'Q ' || item_id, item_id::VARCHAR, t, NULL FROM items WHERE item_id % 4 = 3""")
def localization_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four forms of a localization source."""
    files = items(spark, sf_dir).select(F.col("item_id").cast("string").alias("path"), by_case(LOCAL).alias("text"))
    return rec.read_localization(files).select("file", "ord", "id", "passage", "from_text", "to_text", "all_sites")


@query("SELECT conv_id::VARCHAR AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, turn::VARCHAR AS \"from\", text AS \"to\", role AS note FROM conversations")
def glossary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as glossary files of CSV: quotes and line breaks inside of cells come back as they were."""
    row = F.concat_ws(",", *[ar.csv_cell(F.col(c)) for c in ("turn", "text", "role")])
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", row.alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "row"))), lambda x: x["row"]), "\r\n")
    files = rows.groupBy("conv_id").agg(body.alias("body")).select(F.col("conv_id").cast("string").alias("path"), F.concat(F.lit("﻿from,to,note\r\n"), "body", F.lit("\r\n")).alias("text"))
    return rec.read_glossary(files)


@query(f"""WITH {UNITS}, n AS (SELECT count(*) AS n FROM units) SELECT p.part, u.unit_id, regexp_replace(raw_text, '[A-Za-z]+', '\\0x', 'g') AS translation, substr(sha256(raw_text), 1, 24) AS raw_source_hash, 'sha of the story' AS story_sha FROM units u, (SELECT unnest(['jsonl', 'csv']) AS part) p""")
def kit_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units as kits of 500, written to the shared folder and read again: each comes back in both files of its archive."""
    docs = table(spark, sf_dir, "documents")
    own = units(docs).withColumns({"kind": F.lit("passage_text"), "family": F.lit("narrative"), "risk_level": F.lit("L0")})
    texts = docs.select(F.concat(F.lit("doc"), "doc_id").alias("name"), F.coalesce("text", F.lit("")).alias("content"))
    own = own.withColumn("start_offset", F.col("start_offset").cast("int")).withColumn("end_offset", F.col("end_offset").cast("int"))
    places = kit.chunks(own.select("unit_id", "doc_id", "i"), 500, ("doc_id", "i")).select(F.col("unit_id").alias("unitId"), "chunk", "filename", "row_index")
    rows = kit.segments(own, texts).join(own.select(F.col("unit_id").alias("unitId"), "raw_text"), "unitId").withColumn("translation", tc.pseudo(F.col("raw_text"))).drop("raw_text")
    folder = new_path(spark, "kits")
    ar.write_kits(rows.join(places, "unitId"), folder, {"targetStory": {"sha256": "sha of the story"}})
    return ar.read_kits(spark, folder).select("part", "unit_id", "translation", "raw_source_hash", "story_sha")


# Planner --------------------------------------------------------------------------------------------------------------

SITES = [  # text before and after: two translations apart, one translation twice, two translations side by side
    ("A bell, §t. B bell.", "A gong, §t. B chime."),
    ("A bell, §t. B bell.", "A gong, §t. B gong."),
    ("bell bell bell §t", "gong chime bell §t"),
]


def _planned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = items(spark, sf_dir)
    text = by_case([x[0] for x in SITES])
    second = F.when(F.col("item_id") % 3 == 2, 5).otherwise(F.length("t") + 12)
    sites = F.array(
        F.struct(F.lit("a").alias("u"), F.when(F.col("item_id") % 3 == 2, 0).otherwise(2).alias("at"), F.lit("gong").alias("to")),
        F.struct(F.lit("b").alias("u"), second.alias("at"), F.when(F.col("item_id") % 3 == 1, "gong").otherwise("chime").alias("to")),
    )
    name = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    own = rows.select(name.alias("passage"), F.explode(sites).alias("s"))
    own = own.select("passage", F.concat("passage", F.lit(":"), "s.u").alias("unit_id"), F.col("s.at").cast("int").alias("start_offset"), (F.col("s.at") + 4).cast("int").alias("end_offset"), F.lit("bell").alias("raw_text"), F.array().cast(tc.MARKS_TYPE).alias("placeholders"), F.col("s.to").alias("translation"))
    return own, rows.select(name.alias("name"), text.alias("content"))


@query(f"WITH {ITEMS} SELECT 'item ' || item_id AS passage, {by_case_sql([x[1] for x in SITES])} AS text FROM items")
def plan_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated words with one or several translations, apart or side by side: the entries, made one after another, give the text with its sites exchanged."""
    own, texts = _planned(spark, sf_dir)
    return pl.replayed(pl.build_plan(own, texts), texts)


@query(f"""WITH {ITEMS}, u AS (SELECT item_id, 'item ' || item_id AS passage, unnest(['a', 'b']) AS u FROM items)
           SELECT passage, passage || ':' || u AS unit_id, CASE item_id % 3 WHEN 1 THEN CASE u WHEN 'a' THEN 'uniform-all' ELSE 'duplicate-superseded' END ELSE 'anchored' END AS how FROM u WHERE item_id % 3 < 2
           UNION ALL SELECT passage, passage || ':' || u, 'cluster' FROM u WHERE item_id % 3 = 2""")
def plan_how(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each unit was placed."""
    return pl.build_plan(*_planned(spark, sf_dir)).where("what = 'covered'").select("passage", "unit_id", F.col("reason").alias("how"))


FAULTS = [  # entries (from, to, all, raw, span), and their codes
    ([("bell", "gong", False, "bell", (2, 6))], ""),
    ([("horn", "gong", False, "bell", (2, 6))], "FROM_MISSING|PATCH_REPLAY_MISMATCH"),
    ([("bell", "bell", False, "bell", (2, 6))], "NO_OP"),
    ([("bell", "gong", False, "horn", (2, 6))], "SPAN_MISMATCH"),
    ([("l", "i", False, "l", (4, 5))], "ALL_FLAG_MISSING"),
    ([("bell", "gong", False, "bell", (2, 6)), ("ell, ", "ong ", False, "ell, ", (3, 8))], "OVERLAP"),
    (None, "PASSAGE_MISSING"),
]


@query(f"WITH {ITEMS}, c AS (SELECT item_id, {by_case_sql([x[1] for x in FAULTS])} AS codes FROM items) SELECT 'item ' || item_id AS passage, unnest(string_split(codes, '|')) AS code FROM c WHERE codes <> ''")
def entry_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that are wrong in one way each."""
    rows, name = items(spark, sf_dir), F.concat(F.lit("item "), F.col("item_id").cast("string"))
    made = []
    for k, (entries, _) in enumerate(FAULTS):
        for n, (frm, to, every, raw, (a, b)) in enumerate(entries or [("bell", "gong", False, "bell", (2, 6))]):
            covers = F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")))
            made.append(rows.where(F.col("item_id") % len(FAULTS) == k).select(name.alias("passage"), F.lit(str(n)).alias("unit_id"), F.lit(frm).alias("from_text"), F.lit(to).alias("to_text"), F.lit(every).alias("all_sites"), F.lit(raw).alias("raw_from"), F.lit(a).alias("span_start"), F.lit(b).alias("span_end"), covers.alias("covers")))
    every = made[0]
    for x in made[1:]:
        every = every.unionByName(x)
    texts = rows.where(F.col("item_id") % len(FAULTS) != len(FAULTS) - 1).select(name.alias("name"), F.concat(F.lit("A bell, "), F.regexp_replace("t", "[ehbl]", "o")).alias("content"))
    return pl.entry_failures(every, texts).select("passage", "code").distinct()
