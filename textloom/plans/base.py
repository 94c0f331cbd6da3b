"""How the given tables stand for stories, units and records; the same in Spark and in SQL.

Documents are passages and each line with a word is a unit.  Labels say which documents have a translation: those of quality 0 are
stale, those that are toxic repeat their source.  Benchmark items are records of units that no longer exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import columns as tc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan of fewer files than there are cores, dealt out before costly work on its rows; others stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if len(scan.inputFiles()) < cores else scan


STEP = 64


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, i, line, start_offset) of every line, offsets in code points, without a shuffle: a line's start is the sum of the sizes before it
    in its own row, by steps of lines, so that long texts don't cost a square."""
    zero = F.lit(0).cast("long")

    def total(sizes: Column) -> Column:
        return F.aggregate(sizes, zero, lambda a, x: a + x)

    rows = spread(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    rows = rows.withColumn("sizes", F.transform("lines", lambda x: F.length(x).cast("long") + 1))
    rows = rows.withColumn("steps", F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / STEP).cast("int")), lambda k: total(F.slice("sizes", k * STEP + 1, F.lit(STEP)))))
    rows = rows.withColumn("before", F.transform("steps", lambda x, k: total(F.slice("steps", F.lit(1), k))))
    start = F.transform("lines", lambda x, i: F.struct(x.alias("line"), (F.get("before", F.floor(i / STEP).cast("int")) + total(F.slice("sizes", (F.floor(i / STEP) * STEP + 1).cast("int"), i % STEP))).alias("start_offset")))
    return rows.select("doc_id", F.posexplode(start).alias("i", "x")).select("doc_id", "i", "x.line", "x.start_offset")


def units(docs: DataFrame) -> DataFrame:
    rows = lines(docs).where(tc.has_word(F.col("line")))
    end = F.col("start_offset") + F.length("line")
    unit_id = F.concat_ws("", F.col("doc_id").cast("string"), F.lit(":"), "start_offset", F.lit("-"), end)
    return rows.select(unit_id.alias("unit_id"), "doc_id", F.concat(F.lit("doc"), "doc_id").alias("passage"), "i", "start_offset", end.cast("long").alias("end_offset"), F.col("line").alias("raw_text"), F.col("line").alias("protected_text"), F.array().cast(tc.MARKS_TYPE).alias("placeholders"), F.lit(None).cast("string").alias("context"))


def records(spark: SparkSession, sf_dir: str, own: DataFrame) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    live = own.join(labels, "doc_id")
    text = F.col("raw_text")
    live = live.select("unit_id", "passage", F.when(F.col("toxic") == 1, text).otherwise(F.concat(text, F.lit(" zz"))).alias("translation"), F.lit(None).cast("string").alias("protected_translation"), F.when(F.col("quality") == 0, "stale").otherwise(tc.source_fingerprint(text)).alias("source_fingerprint"))
    gone = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("gone:"), "item_id").alias("unit_id"), F.lit("gone").alias("passage"), F.col("text").alias("translation"), F.lit(None).cast("string").alias("protected_translation"), F.lit("x").alias("source_fingerprint"))
    return live.unionByName(gone)


SPACES = r"[\s\x0b\x{85}\p{Z}\x{feff}]+"


def fold_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'))"


def normalize_sql(x: str) -> str:
    for pattern, by in ((r"<!--[\s\S]*?-->", "' '"), (r"/\*[\s\S]*?\*/", "' '"), (r"<<[\s\S]*?>>", "chr(1) || chr(1)"), (r"<[^>]+>", "' '"), (tc.ENTITY, "' '"), (tc.PLACEHOLDER, "chr(1) || chr(1)")):
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return fold_sql(x)


def fingerprint_sql(x: str) -> str:
    return f"substr(sha256({normalize_sql(x)}), 1, 16)"


LINES = """
lines AS (SELECT doc_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset
          FROM (SELECT doc_id, (k - 1)::INT AS i, ls[k] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))))"""
UNITS = f"""{LINES},
units AS (SELECT doc_id || ':' || start_offset || '-' || (start_offset + length(line)) AS unit_id, doc_id, 'doc' || doc_id AS passage, i, start_offset, start_offset + length(line) AS end_offset, line AS raw_text
          FROM lines WHERE regexp_matches(line, '[A-Za-z]{{2,}}'))"""
RECORDS = f"""{UNITS},
records AS (SELECT unit_id, passage, CASE WHEN toxic = 1 THEN raw_text ELSE raw_text || ' zz' END AS translation, CASE WHEN quality = 0 THEN 'stale' ELSE {fingerprint_sql('raw_text')} END AS source_fingerprint
            FROM units JOIN labels USING (doc_id)
            UNION ALL SELECT 'gone:' || item_id, 'gone', text, 'x' FROM benchmark)"""
STATES = f"""{RECORDS},
states AS (SELECT coalesce(u.unit_id, r.unit_id) AS unit_id, coalesce(u.passage, r.passage) AS passage,
    CASE WHEN u.unit_id IS NULL THEN 'obsolete' WHEN r.unit_id IS NULL THEN 'untranslated' WHEN r.source_fingerprint <> {fingerprint_sql('u.raw_text')} THEN 'superseded'
         WHEN r.translation = u.raw_text OR (length(r.translation) - length(replace(r.translation, '`', ''))) % 2 = 1 THEN 'rejected-structure' ELSE 'translated-valid' END AS state
    FROM units u FULL OUTER JOIN records r ON u.unit_id = r.unit_id)"""
