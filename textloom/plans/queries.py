"""The engine's registered queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import columns as tc
from textloom.operators import coverage as cov
from textloom.operators import editor as ed
from textloom.operators import inventory as inv
from textloom.operators import kit
from textloom.operators import migration as mig
from textloom.operators import planner as pl
from textloom.operators import scenarios as sc
from textloom.operators import tokens as tk
from textloom.plans.base import LINES, RECORDS, STATES, UNITS, fingerprint_sql, fold_sql, lines, normalize_sql, records, spread, table, units
from textloom.sources import archive as ar
from textloom.sources import story as st
from textloom.streaming import imports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def own_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(table(spark, sf_dir, "documents"))


def own_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = own_units(spark, sf_dir)
    return cov.classify_coverage(u, records(spark, sf_dir, u))


# Inventory ------------------------------------------------------------------------------------------------------------


@query(f"WITH {UNITS} SELECT unit_id, passage, i, start_offset, end_offset, raw_text FROM units")
def units_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own_units(spark, sf_dir).select("unit_id", "passage", "i", "start_offset", "end_offset", "raw_text")


@query(f"WITH {LINES} SELECT doc_id, i, start_offset, length(line)::BIGINT AS n FROM lines")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents")).select("doc_id", "i", "start_offset", F.length("line").cast("long").alias("n"))


@query(f"WITH {UNITS} SELECT unit_id, {normalize_sql('raw_text')} AS normal, {fingerprint_sql('raw_text')} AS source_fingerprint, substr(sha256(raw_text), 1, 24) AS protected_hash FROM units")
def source_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("protected_text")
    return own_units(spark, sf_dir).select("unit_id", tc.normalize_source(text).alias("normal"), tc.source_fingerprint(text).alias("source_fingerprint"), tc.protected_hash(text).alias("protected_hash"))


@query(f"WITH {UNITS} SELECT 'sha256:' || substr(sha256(string_agg(unit_id || chr(0) || substr(sha256(raw_text), 1, 24), chr(10) ORDER BY unit_id || chr(0) || substr(sha256(raw_text), 1, 24))), 1, 32) AS fingerprint FROM units")
def inventory_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.inventory_fingerprint(own_units(spark, sf_dir))


@query(f"""WITH {UNITS}, faces AS (SELECT 'kind' AS facet, 'passage_text' AS value FROM units UNION ALL SELECT 'risk', CASE WHEN contains(raw_text, '|') THEN 'L1' ELSE 'L0' END FROM units
           UNION ALL SELECT 'area', source FROM units JOIN documents USING (doc_id)) SELECT facet, value, count(*) AS n FROM faces GROUP BY facet, value""")
def inventory_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = own_units(spark, sf_dir).join(docs, "doc_id").select(F.lit("passage_text").alias("kind"), tc.risk(F.lit(0), F.contains("raw_text", F.lit("|")).cast("int")).alias("risk_level"), F.col("source").alias("family"))
    return inv.histograms(rows)


@query("SELECT source, CASE WHEN regexp_matches(source, '(?i)widget') THEN 'widgets' WHEN regexp_matches(source, '(?i)setting|option|menu|save|load|slot|panel|button|hud|footer|version|import|export|config') THEN 'ui' ELSE 'narrative' END AS area, count(*) AS n FROM documents GROUP BY ALL")
def area_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source", tc.area(F.array().cast("array<string>"), F.col("source")).alias("area")).agg(F.count("*").alias("n"))


def _story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as passages: their markup has tags, comments, references and scripts."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select(F.col("page_id").alias("passage_ord"), F.col("page_id").cast("int").alias("pid"), F.col("url").alias("name"), F.array().cast("array<string>").alias("tags"), F.col("html").alias("content"), F.lit(0).cast("long").alias("content_offset"))


@query()
def text_units_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = inv.scan_passages(_story(spark, sf_dir))
    return inv.units(scanned).where("claim = 1").select("unit_id", "passage", "kind", "family", "risk_level", "start_offset", "end_offset", "raw_text", "protected_text", F.size("placeholders").alias("n_placeholders"))


_MARKED = "'<<if $n gt ' || item_id || '>>' || regexp_replace(text, '[^A-Za-z ]', '', 'g') || ' <<he>><<else>>Other words here<<endif>> [[Go on|Room ' || item_id || ']]'"


@query(f"""WITH marked AS (SELECT item_id, {_MARKED} AS content, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS t, '<<if $n gt ' || item_id || '>>' AS head FROM benchmark)
           SELECT item_id || ':' || length(head) || '-' || (length(head) + length(t) + 7) AS unit_id, 'passage_text' AS kind, 'L2' AS risk_level, t || ' ⟦0⟧' AS protected_text FROM marked
           UNION ALL SELECT item_id || ':' || (length(head) + length(t) + 15) || '-' || (length(head) + length(t) + 31), 'passage_text', 'L2', 'Other words here' FROM marked
           UNION ALL SELECT item_id || ':' || (length(head) + length(t) + 43) || '-' || (length(head) + length(t) + 48), 'link_label', 'L1', 'Go on' FROM marked""")
def marked_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanner on marked-up benchmark texts, whose units are known in advance."""
    text = F.regexp_replace("text", "[^A-Za-z ]", "")
    item = F.col("item_id").cast("string")
    content = F.concat(F.lit("<<if $n gt "), item, F.lit(">>"), text, F.lit(" <<he>><<else>>Other words here<<endif>> [[Go on|Room "), item, F.lit("]]"))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("passage_ord"), F.col("item_id").cast("int").alias("pid"), F.concat(F.lit("item "), item).alias("name"), F.array().cast("array<string>").alias("tags"), content.alias("content"), F.lit(0).cast("long").alias("content_offset"))
    return inv.units(inv.scan_passages(rows)).select("unit_id", "kind", "risk_level", "protected_text")


@query("SELECT 'room ' || item_id AS key FROM benchmark UNION SELECT 'item ' || item_id FROM benchmark UNION SELECT 'key ' || (item_id % 7) FROM benchmark")
def identifier_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id").cast("string")
    content = F.concat(F.lit("[[Go|Room "), item, F.lit(']] <<goto "Key '), (F.col("item_id") % 7).cast("string"), F.lit('">> {id: "'), F.lit("item "), item, F.lit('"}'))
    return inv.identifier_space(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("Item "), item).alias("name"), content.alias("content")))


# Coverage -------------------------------------------------------------------------------------------------------------


@query(f"WITH {STATES} SELECT unit_id, passage, state FROM states")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own_states(spark, sf_dir).select("unit_id", "passage", "state")


@query(f"WITH {STATES}, every AS (SELECT unnest(['translated-valid', 'untranslated', 'rejected-structure', 'superseded', 'unresolved', 'obsolete']) AS state) SELECT e.state, count(s.state) AS n FROM every e LEFT JOIN states s USING (state) GROUP BY e.state")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.coverage_counts(own_states(spark, sf_dir))


@query(f"WITH {STATES} SELECT lang, state, count(*) AS n FROM states JOIN documents ON passage = 'doc' || doc_id GROUP BY lang, state")
def coverage_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("passage"), "lang")
    return own_states(spark, sf_dir).join(docs, "passage").groupBy("lang", "state").agg(F.count("*").alias("n"))


@query(f"""WITH {STATES} SELECT count(*) FILTER (WHERE state IN ('untranslated', 'rejected-structure', 'superseded', 'unresolved')) AS blocking_total, count(*) FILTER (WHERE state IN ('untranslated', 'rejected-structure', 'superseded', 'unresolved')) = 0 AS strict_pass,
           count(*) FILTER (WHERE state = 'untranslated') AS missing, count(*) FILTER (WHERE state = 'superseded') AS changed, count(*) FILTER (WHERE state = 'rejected-structure') AS rejected, count(*) FILTER (WHERE state = 'obsolete') AS obsolete FROM states""")
def strict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cov.strict_gate(own_states(spark, sf_dir))


@query(f"WITH {STATES} SELECT unit_id, CASE WHEN state = 'translated-valid' AND d.doc_id IS NOT NULL THEN 'unresolved' ELSE state END AS state FROM states LEFT JOIN (SELECT doc_id FROM documents WHERE contains(text, '|')) d ON passage = 'doc' || d.doc_id")
def mark_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("|"))).select(F.concat(F.lit("doc"), "doc_id").alias("passage"))
    states = own_states(spark, sf_dir)
    return cov.mark_unresolved(states, states.join(odd, "passage", "left_semi").select("unit_id")).select("unit_id", "state")


# Kits -----------------------------------------------------------------------------------------------------------------


def _both_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Returned files from conversations: user turns as JSONL, assistant turns as CSV, by turn pair."""
    c = table(spark, sf_dir, "conversations")
    unit = F.concat("conv_id", F.lit("-"), F.floor(F.col("turn") / 2)).alias("unit_id")
    text = F.when(F.length("text") % 3 == 0, F.lit(" ")).when(F.length("text") % 3 == 1, F.concat(F.lit("conv "), "conv_id")).otherwise(F.col("text")).alias("translation")
    return tuple(c.where(F.col("turn") % 2 == k).select(unit, text, F.col("turn").alias("ord")) for k in (0, 1))


_FILES = """
turns AS (SELECT conv_id || '-' || (turn // 2) AS unit_id, turn, CASE length(text) % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'conv ' || conv_id ELSE text END AS t FROM conversations),
j AS (SELECT unit_id, arg_max(t, turn) AS jt FROM turns WHERE turn % 2 = 0 GROUP BY unit_id), c AS (SELECT unit_id, arg_max(t, turn) AS ct FROM turns WHERE turn % 2 = 1 GROUP BY unit_id),
merged AS (SELECT unit_id, nullif(trim(jt, ' ' || chr(9) || chr(10) || chr(13)), '') AS a, nullif(trim(ct, ' ' || chr(9) || chr(10) || chr(13)), '') AS b FROM j FULL OUTER JOIN c USING (unit_id))"""


@query(f"WITH {_FILES} SELECT unit_id, CASE WHEN a <> b THEN NULL ELSE coalesce(a, b, '') END AS translation, CASE WHEN a <> b THEN NULL WHEN a IS NOT NULL THEN 'jsonl' WHEN b IS NOT NULL THEN 'csv' ELSE 'none' END AS source, coalesce(a <> b, FALSE) AS conflict FROM merged")
def merge_jsonl_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kit.merge_segments(*_both_files(spark, sf_dir)).select("unit_id", "translation", "source", "conflict")


@query(f"WITH {RECORDS}, new AS (SELECT 'gone:' || item_id AS unit_id, 'new' AS passage, lower(text) AS translation, 'y' AS source_fingerprint FROM benchmark) SELECT * FROM records WHERE unit_id NOT IN (SELECT unit_id FROM new) UNION ALL SELECT * FROM new")
def upsert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = records(spark, sf_dir, own_units(spark, sf_dir)).drop("protected_translation")
    new = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("gone:"), "item_id").alias("unit_id"), F.lit("new").alias("passage"), F.lower("text").alias("translation"), F.lit("y").alias("source_fingerprint"))
    return kit.upsert_records(old, new)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned entries: records with what their fingerprint declares; stale ones don't fit, those of toxic documents are blank."""
    none = F.lit(None).cast("string")
    own = records(spark, sf_dir, own_units(spark, sf_dir))
    return own.select("unit_id", F.lit(0).alias("ord"), F.when(F.length("translation") % 5 == 0, "").otherwise(F.col("translation")).alias("translation"), none.alias("raw_source_hash"), none.alias("protected_hash"), "source_fingerprint", none.alias("structural_fingerprint"))


_IMPORT = f"""{RECORDS},
checks AS (SELECT r.unit_id, CASE WHEN u.unit_id IS NULL THEN 'unit-not-in-target' WHEN length(r.translation) % 5 = 0 THEN 'empty-translation' WHEN r.source_fingerprint <> {fingerprint_sql('u.raw_text')} THEN 'source-fingerprint-mismatch'
           WHEN r.translation = u.raw_text OR (length(r.translation) - length(replace(r.translation, '`', ''))) % 2 = 1 THEN 'qa-failed' END AS reason FROM records r LEFT JOIN units u USING (unit_id))"""


@query(f"WITH {_IMPORT} SELECT unit_id, CASE WHEN reason IS NULL THEN 'accepted' WHEN reason = 'empty-translation' THEN 'deferred' ELSE 'rejected' END AS status, reason FROM checks")
def import_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kit.classify_import(_entries(spark, sf_dir), own_units(spark, sf_dir)).select("unit_id", "status", "reason")


@query(f"""WITH {_IMPORT}, {_FILES}, n AS (SELECT count(*) FILTER (WHERE reason IS NULL) AS accepted, count(*) FILTER (WHERE reason <> 'empty-translation') AS rejected, count(*) FILTER (WHERE reason = 'empty-translation') AS deferred, count(*) AS kit FROM checks),
           k AS (SELECT count(*) AS conflicts FROM merged WHERE a <> b)
           SELECT accepted, rejected, deferred, conflicts, kit + conflicts AS kit_units, TRUE AS coverage_ok, rejected + deferred + conflicts AS blocker_total, TRUE AS ok FROM n, k""")
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = kit.classify_import(_entries(spark, sf_dir), own_units(spark, sf_dir))
    conflicts = kit.merge_segments(*_both_files(spark, sf_dir)).where("conflict")
    return kit.import_report(results, conflicts)


@query(f"""WITH {_IMPORT} SELECT c.unit_id, CASE WHEN reason = 'empty-translation' THEN 'deferred' ELSE 'rejected' END AS status, reason, CASE WHEN reason = 'empty-translation' THEN '' ELSE r.translation END AS translation
           FROM checks c JOIN units u USING (unit_id) JOIN records r ON r.unit_id = c.unit_id WHERE reason IS NOT NULL""")
def repair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = own_units(spark, sf_dir)
    blockers = kit.import_blockers(kit.classify_import(_entries(spark, sf_dir), own), kit.merge_segments(*_both_files(spark, sf_dir)).where("conflict"))
    return kit.repair_kit(blockers, own)[0].select("unit_id", "status", "reason", "translation")


@query(f"WITH {UNITS} SELECT unit_id, (n // 500)::INT AS chunk, 'localization-kit-' || lpad((n // 500 + 1)::VARCHAR, greatest(3, length((max(n // 500) OVER () + 1)::VARCHAR))::INT, '0') || '.zip' AS filename FROM (SELECT unit_id, row_number() OVER (ORDER BY doc_id, i) - 1 AS n FROM units)")
def chunk_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kit.chunks(own_units(spark, sf_dir), 500, ("doc_id", "i")).select("unit_id", "chunk", "filename")


@query(f"WITH {STATES} SELECT u.unit_id, u.raw_text FROM units u JOIN states s USING (unit_id) WHERE s.state = 'superseded' ORDER BY u.doc_id, u.i LIMIT 250")
def scope_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export's own limit: the first 250 changed units in inventory order."""
    return kit.select_export(own_units(spark, sf_dir), own_states(spark, sf_dir), "changed", 250, ("doc_id", "i")).select("unit_id", "raw_text")


@query(f"WITH {UNITS} SELECT unit_id, substr(text, greatest(0, start_offset - 160)::BIGINT + 1, start_offset::BIGINT - greatest(0, start_offset - 160)::BIGINT) AS before, substr(text, end_offset::BIGINT + 1, 160) AS after FROM units JOIN documents USING (doc_id)")
def context_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = own_units(spark, sf_dir).join(docs, "doc_id")
    before, after = tc.context_slices(F.col("text"), F.col("start_offset").cast("int"), F.col("end_offset").cast("int"))
    return both.select("unit_id", before.alias("before"), after.alias("after"))


# Migration, matching, alignment ---------------------------------------------------------------------------------------

_SHIFTED = f"""{RECORDS},
fresh AS (SELECT CASE WHEN quality = 1 THEN unit_id ELSE unit_id || 'x' END AS unit_id, passage, i, doc_id, {fingerprint_sql('raw_text')} AS fp FROM units LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR toxic = 0),
keyed AS (SELECT fp, arg_max(unit_id, doc_id * 100000 + i) AS target FROM fresh GROUP BY fp)"""


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A newer version's units: those of toxic documents are gone, and all but those of documents of quality 1 have moved."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    u = own_units(spark, sf_dir).join(labels, "doc_id", "left").where("quality IS NULL OR toxic = 0")
    return u.select(F.when(F.col("quality") == 1, F.col("unit_id")).otherwise(F.concat("unit_id", F.lit("x"))).alias("unit_id"), "passage", tc.source_fingerprint(F.col("raw_text")).alias("source_fingerprint"), F.lit("s").alias("structural_fingerprint"), (F.col("doc_id") * 100000 + F.col("i")).alias("unit_ord"))


_MIGRATED = f"""{_SHIFTED},
outcomes AS (SELECT r.unit_id, CASE WHEN f.unit_id IS NOT NULL THEN 'kept' WHEN k.target IS NOT NULL THEN 'moved' WHEN p.passage IS NOT NULL THEN 'changed' ELSE 'obsolete' END AS outcome, CASE WHEN f.unit_id IS NOT NULL THEN r.unit_id ELSE k.target END AS new_unit_id
             FROM records r LEFT JOIN (SELECT DISTINCT unit_id FROM fresh) f ON r.unit_id = f.unit_id LEFT JOIN keyed k ON r.source_fingerprint = k.fp LEFT JOIN (SELECT DISTINCT passage FROM fresh) p ON r.passage = p.passage)"""


@query(f"WITH {_MIGRATED} SELECT unit_id, outcome, new_unit_id FROM outcomes")
def migrate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = records(spark, sf_dir, own_units(spark, sf_dir)).withColumn("structural_fingerprint", F.lit("s"))
    return mig.migrate_records(old, _shifted(spark, sf_dir))


@query(f"WITH {_MIGRATED} SELECT count(*) FILTER (WHERE outcome = 'kept') AS kept, count(*) FILTER (WHERE outcome = 'moved') AS moved, count(*) FILTER (WHERE outcome = 'changed') AS changed, count(*) FILTER (WHERE outcome = 'obsolete') AS obsolete, (SELECT coalesce(string_agg(unit_id, '|' ORDER BY unit_id), '') FROM (SELECT unit_id FROM outcomes WHERE outcome = 'moved' ORDER BY unit_id LIMIT 20)) AS moved_sample FROM outcomes")
def migration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mig.migration_report(migrate_records(spark, sf_dir)).withColumn("moved_sample", F.array_join("moved_sample", "|"))


@query(f"WITH {UNITS} SELECT e.doc_id, u.unit_id FROM units e JOIN labels USING (doc_id) JOIN units u ON u.passage = e.passage AND u.raw_text = e.raw_text")
def match_source_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of labelled documents as entries: each meets every unit of its passage with the same text."""
    u, labels = own_units(spark, sf_dir), table(spark, sf_dir, "labels").select("doc_id")
    entries = u.join(labels, "doc_id").select("doc_id", "passage", F.col("raw_text").alias("from_text"))
    return mig.match_entries(entries, u)[0].select("doc_id", "unit_id")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents: the older lacks those without a label and has blank lines, an indent or other words in some."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    both = docs.join(labels, "doc_id")
    old = F.when(F.col("toxic") == 1, F.concat(F.lit("\n\n"), "text")).when(F.col("quality") == 0, F.concat(F.lit("zz"), "text")).otherwise(F.concat("text", F.lit(" \n")))
    return both.select(F.concat(F.lit("doc"), "doc_id").alias("name"), old.alias("raw")), docs.select(F.concat(F.lit("doc"), "doc_id").alias("name"), F.col("text").alias("content"), F.col("doc_id").alias("ord"))


_END = r"regexp_replace(%s, '[\s\x0b\x{85}\p{Z}\x{feff}]+$', '')"
_VERSIONS = """
old AS (SELECT 'doc' || doc_id AS name, CASE WHEN toxic = 1 THEN chr(10) || chr(10) || text WHEN quality = 0 THEN 'zz' || text ELSE text || ' ' || chr(10) END AS raw FROM documents JOIN labels USING (doc_id)),
body AS (SELECT name, raw, CASE WHEN raw LIKE chr(10) || '%' THEN regexp_replace(raw, '^\\n+', '') ELSE regexp_replace(raw, '^[ \\t]+', '') END AS body FROM old),
fresh AS (SELECT 'doc' || doc_id AS name, text AS content FROM documents)"""


@query(f"""WITH {_VERSIONS} SELECT name, CASE WHEN content IS NULL THEN 'source-only' WHEN raw IS NULL THEN 'target-only' WHEN {_END % 'content'} = {_END % 'raw'} THEN 'exact' WHEN {_END % 'content'} = {_END % 'body'} THEN 'normalized' ELSE 'changed' END AS relation
           FROM body FULL OUTER JOIN fresh USING (name)""")
def align_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mig.align_passages(*_versions(spark, sf_dir))


@query(f"WITH {_VERSIONS} SELECT name, CASE WHEN raw IS NULL THEN 'target-added' WHEN {fold_sql('raw')} = {fold_sql('content')} THEN 'base-identical' ELSE 'target-modified' END AS relation FROM fresh LEFT JOIN old USING (name)")
def passage_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return mig.passage_relations(new, old.withColumnRenamed("raw", "content"))


@query(f"""WITH {_VERSIONS}, base AS (SELECT * FROM body WHERE raw LIKE chr(10) || '%')
           SELECT f.name AS passage, CASE WHEN contains({fold_sql('m.body')}, {fold_sql('f.content')}) AND b.name IS NULL THEN 'upstream-added' WHEN contains({fold_sql('m.body')}, {fold_sql('f.content')}) THEN 'base-identical' WHEN m.name IS NULL THEN 'target-added' ELSE 'target-modified' END AS relation
           FROM fresh f LEFT JOIN body m ON f.name = m.name LEFT JOIN base b ON f.name = b.name""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    base = old.where(F.col("raw").startswith("\n"))
    rows = new.select(F.col("name").alias("passage"), F.col("content").alias("from_text"))
    return mig.provenance(rows, base, old, new.select("name", F.col("content").alias("raw")), new).select("passage", "relation")


# Editing --------------------------------------------------------------------------------------------------------------


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with the translations of their records; toxic documents are flagged, those of quality 1 reviewed."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    u = own_units(spark, sf_dir).join(labels, "doc_id", "left")
    target = F.when(F.col("quality") == 1, F.concat("raw_text", F.lit(" "), F.col("toxic").cast("string"))).otherwise("")
    status = F.when(F.col("toxic") == 1, "flagged").when(F.col("quality") == 1, "reviewed").otherwise("unmarked")
    return u.select("unit_id", "passage", F.col("raw_text").alias("source"), target.alias("translation"), status.alias("status"), (F.col("doc_id") * 100000 + F.col("i")).alias("ord"))


_SEGMENTS = f"""{UNITS},
segments AS (SELECT unit_id, passage, raw_text AS source, CASE WHEN quality = 1 THEN raw_text || ' ' || toxic ELSE '' END AS translation, CASE WHEN toxic = 1 THEN 'flagged' WHEN quality = 1 THEN 'reviewed' ELSE 'unmarked' END AS status, doc_id * 100000 + i AS ord
             FROM units LEFT JOIN labels USING (doc_id))"""


@query(f"WITH {_SEGMENTS} SELECT source, count(*) AS n, coalesce(min(nullif(translation, '')) <> max(nullif(translation, '')), FALSE) AS divergent, count(*) FILTER (WHERE translation = '') AS empty_count, min(unit_id) AS first_id FROM segments GROUP BY source HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.duplicate_groups(_segments(spark, sf_dir))


@query(f"WITH {_SEGMENTS}, g AS (SELECT source, min(nullif(translation, '')) AS lo, max(nullif(translation, '')) AS hi FROM segments GROUP BY source HAVING count(*) > 1) SELECT unit_id, lo AS after FROM segments JOIN g USING (source) WHERE translation = '' AND lo = hi")
def duplicate_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.duplicate_fill(_segments(spark, sf_dir))


@query(f"WITH {_SEGMENTS} SELECT unit_id, CASE WHEN translation = '' THEN 'change' WHEN translation = source || ' 0' THEN 'identical' ELSE 'conflict' END AS action, CASE WHEN translation = '' THEN source || ' 0' END AS after FROM segments")
def handoff_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _segments(spark, sf_dir)
    return ed.plan_handoff(own, own.select("unit_id", F.concat("source", F.lit(" 0")).alias("translation")), "fill")


@query(f"""WITH {_SEGMENTS} SELECT count(*) AS total, count(*) FILTER (WHERE translation <> '') AS translated, count(*) FILTER (WHERE translation = '') AS untranslated, floor(count(*) FILTER (WHERE translation <> '') * 100 / count(*) + 0.5)::BIGINT AS percent,
           count(*) FILTER (WHERE status = 'proofread') AS proofread, count(*) FILTER (WHERE status = 'reviewed') AS reviewed, count(*) FILTER (WHERE status = 'flagged') AS flagged, count(*) FILTER (WHERE contains(source, '|')) AS issues FROM segments""")
def status_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _segments(spark, sf_dir)
    return ed.status_stats(own, own.select("unit_id", F.when(F.contains("source", F.lit("|")), "error").otherwise("info").alias("severity")))


@query(f"WITH {_SEGMENTS} SELECT unit_id, translation = '' AS todo FROM segments WHERE contains(lower(source), 'the') OR contains(lower(passage), 'the') OR contains(lower(translation), 'the')")
def view_todo_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.view(_segments(spark, sf_dir), query="the", sort="todo").select("unit_id", (~ed.filled(F.col("translation"))).alias("todo"))


@query(f"""WITH {_SEGMENTS}, terms AS (SELECT DISTINCT word AS term, upper(word) AS want FROM (SELECT regexp_extract(text, '^([A-Za-z]+)', 1) AS word FROM benchmark) WHERE word <> ''),
           words AS (SELECT unit_id, translation, unnest(list_distinct(regexp_extract_all(source, '[A-Za-z0-9_]+'))) AS term FROM segments WHERE translation <> '')
           SELECT unit_id, term FROM words JOIN terms USING (term) WHERE NOT contains(translation, want)""")
def terminology_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.regexp_extract("text", "^([A-Za-z]+)", 1)
    terms = table(spark, sf_dir, "benchmark").select(word.alias("source")).where("source != ''").distinct().withColumn("target", F.upper("source"))
    return ed.terminology(_segments(spark, sf_dir), terms)


@query(f"""WITH {_SEGMENTS}, fresh AS (SELECT CASE WHEN status = 'unmarked' THEN unit_id || 'x' ELSE unit_id END AS unit_id, CASE WHEN status = 'flagged' THEN source || '!' ELSE source END AS source FROM segments),
           o AS (SELECT * FROM segments s WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.unit_id = s.unit_id)), l AS (SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE f.unit_id = s.unit_id)),
           no AS (SELECT source, count(*) AS n FROM o GROUP BY source), nl AS (SELECT source, count(*) AS n FROM l GROUP BY source)
           SELECT f.unit_id, CASE WHEN f.source = s.source THEN 'safe' ELSE 'modified' END AS outcome FROM fresh f JOIN segments s USING (unit_id)
           UNION ALL SELECT l.unit_id, CASE WHEN no.n IS NULL THEN 'added' WHEN no.n = 1 AND nl.n = 1 THEN 'suggestion' ELSE 'ambiguous' END FROM l JOIN nl USING (source) LEFT JOIN no USING (source)
           UNION ALL SELECT o.unit_id, 'deleted' FROM o WHERE source NOT IN (SELECT source FROM nl)""")
def editor_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _segments(spark, sf_dir)
    new = own.select(F.when(F.col("status") == "unmarked", F.concat("unit_id", F.lit("x"))).otherwise(F.col("unit_id")).alias("unit_id"), F.when(F.col("status") == "flagged", F.concat("source", F.lit("!"))).otherwise(F.col("source")).alias("source"), "translation")
    return ed.plan_migration(own, new)


# Planner --------------------------------------------------------------------------------------------------------------


@query(f"""WITH {UNITS}, g AS (SELECT doc_id, passage, raw_text AS from_text, count(*) AS sites FROM units GROUP BY ALL HAVING count(*) > 1)
           SELECT passage, from_text, sites, regexp_replace(from_text, '[A-Za-z]+', '\\0x', 'g') AS to_text FROM g JOIN documents USING (doc_id) WHERE (length(text) - length(replace(text, from_text, ''))) // length(from_text) = sites""")
def uniform_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("name"), F.col("text").alias("content"))
    return pl.uniform_groups(own_units(spark, sf_dir).withColumn("translation", tc.pseudo(F.col("raw_text"))), docs)


@query(f"WITH {UNITS}, s AS (SELECT passage, unit_id, start_offset, end_offset + 1 + i % 2 AS end_offset, lag(unit_id) OVER w AS a, lag(end_offset + 1 + i % 2) OVER w AS e FROM units WINDOW w AS (PARTITION BY passage ORDER BY start_offset, end_offset, unit_id)) SELECT passage, a, unit_id AS b FROM s WHERE start_offset < e")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that reach a character too far on every other line."""
    return pl.overlaps(own_units(spark, sf_dir).withColumn("end_offset", F.col("end_offset") + 1 + F.col("i") % 2))


@query(f"WITH {LINES} SELECT 'doc' || doc_id AS passage, string_agg(CASE WHEN regexp_matches(line, '[A-Za-z]{{2,}}') THEN regexp_replace(line, '[A-Za-z]+', '\\0x', 'g') ELSE line END, chr(10) ORDER BY i) AS text FROM lines GROUP BY doc_id")
def replay_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("name"), F.coalesce("text", F.lit("")).alias("content"))
    edits = own_units(spark, sf_dir).select("passage", F.col("start_offset").cast("int").alias("start_offset"), F.col("end_offset").cast("int").alias("end_offset"), tc.pseudo(F.col("raw_text")).alias("to_text"))
    return pl.splice(edits, docs)


def build_plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = own_units(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("name"), F.col("text").alias("content"))
    valid = own_states(spark, sf_dir).where("state = 'translated-valid' AND NOT identity").select("unit_id")
    live = u.join(valid, "unit_id").join(records(spark, sf_dir, u).select("unit_id", "translation"), "unit_id")
    return pl.build_plan(live, docs, whole=True)  # texts that repeat themselves have sites that no lesser entry can hold


@query()
def build_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole planner over units with a valid translation."""
    return build_plan_rows(spark, sf_dir).select("passage", "what", "unit_id", "reason", "from_text", "to_text", "all_sites", "anchored", "span_start", "span_end", "patch_start", "patch_end", "is_cluster")


@query(f"""WITH {STATES} SELECT count(*)::BIGINT AS placed, 0::BIGINT AS failures FROM states WHERE state = 'translated-valid'""")
def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid unit is covered by an entry and no entry fails its replay."""
    plan = build_plan(spark, sf_dir)
    return plan.agg(F.count(F.when(F.col("what") == "covered", 1)).alias("placed"), F.count(F.when(F.col("what") == "failure", 1)).alias("failures"))


# Scalars, bags, tags --------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<[A-Za-z][^<>]*>')) AS tag FROM pages)
          SELECT page_id, count(*) AS tags, sum(len(regexp_extract_all(tag, '[A-Za-z_][A-Za-z0-9_:.-]*="[^"]*"'))) ::BIGINT AS n, max(regexp_extract(tag, 'lang="([^"]*)"', 1)) AS lang FROM t GROUP BY page_id""")
def html_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes of all tags of a page."""
    tag = F.explode(F.regexp_extract_all("html", F.lit("(<[A-Za-z][^<>]*>)"), F.lit(1)))
    rows = table(spark, sf_dir, "pages").select("page_id", tag.alias("tag")).withColumn("found", st.attributes_column(F.col("tag")))
    return rows.groupBy("page_id").agg(F.count("*").alias("tags"), F.sum(F.size("found")).alias("n"), F.max(F.coalesce(F.try_element_at("found", F.lit("lang")), F.lit(""))).alias("lang"))


@query(f"WITH {UNITS} SELECT unit_id, CASE WHEN i % 3 = 0 THEN 'PLACEHOLDER_COUNT_CHANGED' WHEN i % 3 = 1 THEN 'PLACEHOLDER_ORDER_CHANGED' END AS code FROM units")
def placeholder_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("⟦0⟧ "), F.regexp_replace("raw_text", "[⟦⟧]", ""), F.lit(" ⟦1⟧"))
    target = F.when(F.col("i") % 3 == 0, F.replace(source, F.lit("⟦1⟧"), F.lit(""))).when(F.col("i") % 3 == 1, F.concat(F.lit("⟦1⟧"), F.lit(" ⟦0⟧"))).otherwise(source)
    return own_units(spark, sf_dir).select("unit_id", ed.placeholder_issue(source, target).alias("code"))


@query(f"WITH {UNITS} SELECT unit_id, '<<he>> ' || raw_text || ' $x <<he>>' AS restored FROM units")
def restore_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array(*[F.struct(F.lit(f"⟦{n}⟧").alias("placeholder"), F.lit(raw).alias("raw"), F.lit("macro").alias("kind"), F.lit(None).cast("string").alias("name")) for n, raw in enumerate(("<<he>>", "$x"))])
    text = F.concat(F.lit("⟦0⟧ "), "raw_text", F.lit(" ⟦1⟧ ⟦0⟧"))
    return own_units(spark, sf_dir).select("unit_id", tc.restore(text, marks).alias("restored"))


@query("SELECT doc_id, regexp_replace(text, '[A-Za-z]+', '\\0x', 'g') AS text FROM documents")
def pseudo_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tc.pseudo(F.col("text")).alias("text"))


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS key FROM conversations), pair AS (SELECT a.conv_id, a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
          d AS (SELECT p.conv_id, p.turn, key, CASE WHEN w.turn = p.turn THEN -1 ELSE 1 END AS n FROM pair p JOIN w ON w.conv_id = p.conv_id AND w.turn IN (p.turn, p.turn + 1))
          SELECT conv_id || '-' || turn AS pair, key, sum(n)::BIGINT AS n FROM d GROUP BY ALL HAVING sum(n) <> 0""")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each turn against those of the turn before."""
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", F.split("text", " ").alias("a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.split("text", " ").alias("b"))
    pairs = a.join(b, ["conv_id", "turn"]).select(F.concat("conv_id", F.lit("-"), "turn").alias("pair"), "a", "b")
    return tk.bag_deltas(pairs, "pair").withColumnRenamed("word", "key")


@query("SELECT role AS tag, 'conv' || conv_id AS name, max(turn) AS last FROM conversations GROUP BY ALL")
def tag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.array("role").alias("tags"), F.concat(F.lit("conv"), "conv_id").alias("name"), F.col("turn").alias("passage_ord"))
    return st.by_tag(rows).groupBy("tag", "name").agg(F.max("passage_ord").alias("last"))


@query("SELECT conv_id, arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id")
def first_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    first, last = cov.first_wins(c, "conv_id", "turn"), cov.last_wins(c, "conv_id", "turn")
    return first.select("conv_id", F.col("text").alias("first_text")).join(last.select("conv_id", F.col("text").alias("last_text")), "conv_id")


@query("""SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(html, '<<[^>]*?>>') THEN 'rawMacro' END, CASE WHEN regexp_matches(html, '⟦[0-9]+⟧') THEN 'placeholder' END, CASE WHEN regexp_matches(html, '\\[\\[|\\]\\]') THEN 'unresolvedLink' END,
          CASE WHEN regexp_matches(html, '&lt;&lt;|&amp;lt;|&amp;gt;') THEN 'entityNoise' END, CASE WHEN regexp_matches(html, '\\$\\{[^}]*\\}') THEN 'templateLiteral' END, CASE WHEN regexp_matches(html, '\\$[A-Za-z_]') THEN 'dollarVariable' END], lambda x: x IS NOT NULL), '|') AS leaks FROM pages""")
def leak_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(sc.leaks(F.col("html")), "|").alias("leaks"))


@query("SELECT 'A' AS tier, count(*) AS total, count(*) FILTER (WHERE page_id % 2 = 0) AS passed, max(length(html))::INT AS max_text_length FROM pages")
def scenario_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    scenarios = pages.select(F.col("page_id").cast("string").alias("id"), F.lit("A").alias("tier"), F.lit(None).cast("string").alias("overlay"), F.lit(None).cast("struct<kind: string>").alias("interaction"))
    none = F.lit(None).cast("string")
    results = pages.select(F.col("page_id").cast("string").alias("id"), F.lit(0).alias("ord"), none.alias("fatal"), none.alias("error"), F.lit(0).alias("body_errors"), F.lit(0).alias("after_errors"), F.array().cast("array<string>").alias("require_missing"), F.array().cast("array<string>").alias("introduced"), F.array().cast("array<string>").alias("leaks"), F.when(F.col("page_id") % 2 == 0, F.array(F.lit("t"))).alias("target_found"), F.array().cast("array<string>").alias("source_present"), F.lit(None).cast("struct<open: boolean, content_length: int, name: string>").alias("overlay"), F.lit(None).cast("struct<error: string, applied: boolean, narrowed: boolean>").alias("interaction"), F.length("html").alias("text_length"))
    return sc.summary(sc.verdicts(scenarios, results))


@query("SELECT n::INT AS page, (SELECT max(item_id) + 1 FROM benchmark)::INT AS pages, greatest(1, least(n - 4, (SELECT max(item_id) + 1 FROM benchmark) - 8))::INT AS first, least((SELECT max(item_id) + 1 FROM benchmark), greatest(1, least(n - 4, (SELECT max(item_id) + 1 FROM benchmark) - 8)) + 8)::INT AS last FROM (SELECT item_id + 1 AS n FROM benchmark)")
def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    rows = items.select((F.col("item_id") + 1).cast("int").alias("page")).crossJoin(F.broadcast(items.agg((F.max("item_id") + 1).cast("int").alias("pages"))))  # one row of totals
    first, last = ed.page_window(F.col("page"), F.col("pages"))
    return rows.select("page", "pages", first.alias("first"), last.alias("last"))


@query()
def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of pages by kind; their texts add up to the page."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    rows = tk.token_rows(pages, "page_id", "html")
    return rows.groupBy("page_id", "kind").agg(F.count("*").alias("n")).join(tk.covered(rows, pages, "page_id", "html"), "page_id")


# More of the inventory, by operator -----------------------------------------------------------------------------------


@query(f"WITH {LINES}, f AS (SELECT doc_id, i, line, {fold_sql('line')} AS s FROM lines) SELECT doc_id, i, regexp_matches(line, '[A-Za-z]{{2,}}') AS word, s = '' OR (NOT contains(s, ' ') AND regexp_matches(s, '[$_.\\[\\]{{}}()]')) AS name FROM f")
def label_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "i", tc.has_word(F.col("line")).alias("word"), tc.is_name(F.col("line")).alias("name"))


@query("SELECT page_id, regexp_matches(url, '(?i)^(?:https?://|//)\\S+$') AS url, FALSE AS title FROM pages")
def url_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tc.is_url(F.col("url")).alias("url"), tc.is_url(F.concat(F.lit("Read "), "url")).alias("title"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'th', ''))) // 2 AS n, CASE WHEN instr(text, 'th') > 0 THEN substr(text, 1, instr(text, 'th') - 1) || '[' || substr(text, instr(text, 'th') + 2) ELSE text END AS first, replace(text, 'th', '[') AS every FROM documents")
def literal_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, needle, by = F.col("text"), F.lit("th"), F.lit("[")
    return table(spark, sf_dir, "documents").select("doc_id", tc.occurrences(text, needle).cast("long").alias("n"), tc.replace_first(text, needle, by).alias("first"), F.replace(text, needle, by).alias("every"))


@query("SELECT page_id, NOT regexp_matches(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&[a-zA-Z][a-zA-Z0-9]*;|&#[0-9]+;|&#x[0-9a-fA-F]+;', ' ', 'g'), '[A-Za-z]') AS identity FROM pages")
def structural_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tc.is_identity(F.col("html")).alias("identity"))


@query(f"WITH {UNITS} SELECT unit_id, replace(replace(replace(replace(raw_text, chr(92), chr(92) || chr(92)) || chr(34) || '$' || '{{', chr(34), chr(92) || chr(34)), '$' || '{{', chr(92) || '$' || '{{'), chr(13), chr(92) || 'r') AS escaped FROM units")
def escape_for_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return own_units(spark, sf_dir).select("unit_id", tc.escape_for(F.lit("js-double"), F.concat("raw_text", F.lit('"${'))).alias("escaped"))


@query(f"WITH {UNITS} SELECT unit_id, CASE WHEN i % 4 = 0 THEN 'LINK_LABEL_DELIMITER_INSERTED' WHEN i % 4 = 1 THEN 'MACRO_ARG_DELIMITER_INSERTED' WHEN i % 4 = 2 AND (length(raw_text) - length(replace(raw_text, '`', ''))) % 2 = 0 THEN 'TEXT_BACKTICK_UNBALANCED' END AS code FROM units")
def context_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    case, source = F.col("i") % 4, F.col("raw_text")
    context = F.when(case == 0, "link").when(case == 1, "arg-double").when(case == 3, "js-double")
    target = F.concat(source, F.when(case == 0, "|").when(case == 1, '"').when(case == 2, "`").otherwise('"'))
    return own_units(spark, sf_dir).select("unit_id", tc.context_code(context, source, target).alias("code"))


@query(f"WITH {LINES}, t AS (SELECT doc_id, i, line, sum(CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM lines) SELECT doc_id || '.' AS file, (min(i) + 1)::INT AS line, 'T' || (min(i) // 5)::INT AS name, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE i % 5 <> 0), '') AS raw FROM t GROUP BY doc_id, g")
def parse_plain_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as plain-text sources in which every fifth line is a title."""
    rows = lines(table(spark, sf_dir, "documents")).withColumn("line", F.when(F.col("i") % 5 == 0, F.concat(F.lit(":: T"), F.floor(F.col("i") / 5))).otherwise(F.regexp_replace("line", "^::", "..")))
    files = rows.groupBy(F.concat("doc_id", F.lit(".")).alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return st.parse_source(files).select("file", F.col("line").cast("int").alias("line"), "name", "raw")


@query("SELECT 'conv' || conv_id AS name, arg_max(text, turn) AS content FROM conversations GROUP BY conv_id")
def passages_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv"), "conv_id").alias("name"), F.col("turn").alias("passage_ord"), F.col("text").alias("content"))
    return st.by_name(rows).select("name", "content")


@query(f"""WITH {LINES}, e AS (SELECT l.doc_id, i, line, text, row_number() OVER (PARTITION BY l.doc_id, line ORDER BY i) AS nth, CASE WHEN line = '' THEN 0 ELSE (length(text) - length(replace(text, line, ''))) // length(line) END AS n FROM lines l JOIN labels USING (doc_id) JOIN documents USING (doc_id))
          SELECT doc_id * 100000 + i AS ord, 'doc' || doc_id AS passage, CASE WHEN line <> '' THEN n::INT END AS occurrences, CASE WHEN line = '' THEN 'missing-from' ELSE array_to_string(list_filter([CASE WHEN nth > 1 THEN 'duplicate-passage-from' END, CASE WHEN n > 1 THEN 'occurs-more-than-once' END], lambda x: x IS NOT NULL), '|') END AS errors FROM e""")
def validate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of labelled documents as entries."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id")
    heads = lines(docs).join(labels, "doc_id")
    entries = heads.select((F.col("doc_id") * 100000 + F.col("i")).alias("ord"), F.lit(None).cast("string").alias("id"), F.concat(F.lit("doc"), "doc_id").alias("passage"), F.col("line").alias("from_text"), F.concat("line", F.lit(" zz")).alias("to_text"), F.lit(None).cast("boolean").alias("all_sites"), F.lit(None).cast("array<struct<code: string, reason: string>>").alias("allow"))
    passages = docs.select(F.concat(F.lit("doc"), "doc_id").alias("name"), F.col("text").alias("content"), F.col("doc_id").alias("passage_ord"))
    return mig.validate_entries(entries, passages).select("ord", "passage", "occurrences", F.array_join("errors", "|").alias("errors"))


@query("SELECT url AS path, CASE WHEN page_id % 4 = 0 THEN 'exact' WHEN page_id % 4 = 1 THEN 'version-substituted' WHEN page_id % 4 = 2 THEN 'whitespace' ELSE 'changed' END AS relation FROM (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url)")
def align_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").groupBy(F.col("url").alias("path")).agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html"))
    kind, body = F.col("page_id") % 4, F.concat(F.lit("/* h */\n"), "html")
    source = pages.select("path", F.when(kind == 1, F.concat("html", F.lit("build version"))).when(kind == 2, F.concat("html", F.lit(" \n"))).otherwise(F.col("html")).alias("content"))
    target = pages.select(F.col("path").alias("file"), F.when(kind == 1, F.concat(body, F.lit("2.0"))).when(kind == 3, F.concat(body, F.lit("!"))).otherwise(body).alias("content"))
    return _aligned(source, target)


def _aligned(source: DataFrame, target: DataFrame) -> DataFrame:
    """Paths with doubled slashes are folded by the alignment, so both sides are aligned under a digest of theirs."""
    s, t = source.withColumn("path", F.md5("path")), target.withColumn("file", F.md5("file"))
    names = source.select(F.md5("path").alias("digest"), F.col("path").alias("own"))
    return mig.align_files(s, t, "2.0").join(names, F.col("path") == F.col("digest")).select(F.col("own").alias("path"), "relation")


@query("""WITH e AS (SELECT doc_id, text AS needle FROM documents UNION ALL SELECT doc_id, text || '@' FROM documents)
          SELECT DISTINCT d.doc_id::VARCHAR AS id, e.needle FROM e JOIN documents d USING (doc_id) WHERE NOT contains(d.text, e.needle)""")
def unmet_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc"), "doc_id").alias("passage"), "text").where("text IS NOT NULL")
    expected = docs.select("id", "passage", F.explode(F.array("text", F.concat("text", F.lit("@")))).alias("needle"))
    return sc.unmet_expectations(expected, docs.select("passage", "text"))


@query("SELECT page_id, length(html)::INT AS chars, length(regexp_replace(html, '[\\x00-\\x7F]', '', 'g'))::INT AS non_ascii, length(regexp_replace(html, '[^\\p{L}]', '', 'g'))::INT AS letters FROM pages")
def text_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sc.diagnostics(F.col("html")).alias("d")).select("page_id", "d.chars", "d.non_ascii", "d.letters")


@query("""WITH w AS (SELECT conv_id, list(text ORDER BY turn) AS all_t FROM conversations GROUP BY conv_id)
          SELECT conv_id, array_to_string(list_filter(all_t, lambda x: x <> all_t[1]), '|') AS introduced, array_to_string(list_filter(all_t, lambda x: x = all_t[1]), '|') AS pre_existing FROM w""")
def visible_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("packed"))
    new, old = sc.visible_errors(F.col("packed"), F.slice("packed", 1, 1))
    return rows.select("conv_id", F.array_join(new, "|").alias("introduced"), F.array_join(old, "|").alias("pre_existing"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[\",\\r\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS cell FROM documents")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ar.csv_cell(F.col("text")).alias("cell"))


@query(f"""WITH {_SEGMENTS} SELECT unit_id, CASE WHEN edited IS NULL THEN translation ELSE edited END AS translation, CASE WHEN edited IS NULL THEN status ELSE 'unmarked' END AS status
           FROM (SELECT *, CASE WHEN status = 'flagged' THEN source || '!' END AS edited FROM segments)""")
def apply_edit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _segments(spark, sf_dir)
    events = own.where("status = 'flagged'").select("unit_id", F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.lit("!").alias("s"), F.lit(False).alias("undone")), F.struct(F.lit(2).alias("ord"), F.lit("?").alias("s"), F.lit(True).alias("undone")))).alias("e"), "source")
    log = events.select("unit_id", "e.ord", F.concat("source", "e.s").alias("translation"), "e.undone")
    return ed.apply_events(own, log).select("unit_id", "translation", "status")


@query(f"""WITH {_SEGMENTS} SELECT unit_id, source, CASE WHEN status = 'flagged' THEN 'unmarked' ELSE status END AS status FROM segments WHERE status <> 'reviewed'""")
def adopt_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _segments(spark, sf_dir)
    stored = own.select("unit_id", F.when(F.col("status") == "reviewed", F.concat("source", F.lit("?"))).otherwise(F.col("source")).alias("source"), F.when(F.col("status") == "flagged", "odd").otherwise(F.col("status")).alias("status"))
    return ed.adopt_project(stored, own).select("unit_id", "source", "status")


@query("SELECT item_id, 'if' AS name, FALSE AS closing, ' $n gt ' || item_id AS body FROM benchmark UNION ALL SELECT item_id, 'print', FALSE, ' $x' FROM benchmark UNION ALL SELECT item_id, 'if', TRUE, '' FROM benchmark")
def macro_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("<<if $n gt "), F.col("item_id").cast("string"), F.lit(">>"), "text", F.lit("<<= $x>><</if>>")).alias("content"))
    return tk.macro_rows(items, "item_id", "content").select("item_id", "name", "closing", "body")


@query("""WITH g AS (SELECT p_brand AS name, length(min(p_type)) % 2 AS output, min(p_size) % 2 AS n FROM part GROUP BY p_brand), p AS (SELECT p.p_partkey, p.p_brand AS a, q.p_brand AS b FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey + 1)
          SELECT p_partkey, a, b, coalesce(x.output = y.output AND x.n = y.n, FALSE) AS same FROM p LEFT JOIN g x ON x.name = a LEFT JOIN g y ON y.name = b""")
def equivalent_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as macros: their types say what they print and their sizes what they read, listed in an order of their own; each part's brand meets the next part's."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    rows = part.groupBy(F.col("p_brand").alias("name")).agg((F.length(F.min("p_type")) % 2).cast("string").alias("output"), (F.min("p_size") % 2).alias("n"))
    reads = F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: F.concat(F.lit("$v"), k.cast("string")))
    signs = rows.select("name", *[F.lit(x).alias(x) for x in ("id", "persistence", "argument", "branch")], "output", F.when(F.hash("name") % 2 == 0, F.reverse(reads)).otherwise(reads).alias("reads"), F.array(F.lit("$x")).alias("writes"))
    following = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("b"))
    pairs = part.select("p_partkey", F.col("p_brand").alias("a")).join(following, "p_partkey", "left")
    return tk.equivalent(signs, pairs)


@query(f"WITH {STATES} SELECT 'translated-valid' AS kind, count(*)::BIGINT AS n FROM states WHERE state = 'translated-valid'")
def plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that the plan's entries hold, each once."""
    plan = build_plan_rows(spark, sf_dir).where("what = 'entry'")
    return plan.select(F.explode("covers_units").alias("u")).distinct().agg(F.lit("translated-valid").alias("kind"), F.count("*").alias("n")).select("kind", "n")


@query()
def plan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.plan_stats(build_plan_rows(spark, sf_dir))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond parity: the stream's tumbling windows over the table as a batch."""
    return imports.event_windows(table(spark, sf_dir, "events")).select("start", "event_type", "n")


from textloom.plans import proofs  # noqa: E402, F401  its queries register themselves
