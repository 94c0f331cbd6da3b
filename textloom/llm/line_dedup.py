"""Removal of lines whose key stands in many documents, with DataFrame operations only.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased.  Keys of at least
``min_chars`` code points that are found in at least ``min_docs`` documents lose all their lines everywhere.

1. Lines become (two 64-bit hashes of the key, document, position), once, as a table in the shared folder; no text
   is moved.
2. They are range-partitioned by hash and document and sorted by hash, document and position, so a key of
   a third of all documents is spread over many tasks.  The first line of each (key, document) streams out and
   adds one to the key's count; counts are summed in part before the shuffle.
3. Frequent keys, a table too, meet the lines again.  AQE splits the frequent ones, or sends the frequent keys to all tasks
   where their measured size is below spark.sql.autoBroadcastJoinThreshold.
4. The dropped positions of a document are packed into 63-bit words; words without a dropped line are left
   out.  ``line_bitmaps`` returns these per-document bitmaps, ``apply_bitmaps`` applies them to the texts.

Defined results: a null or empty text is one empty line, and empty lines never have a key that counts, as long as
``min_chars`` is 1 or more.  Rows that repeat a doc_id count as one document and are rewritten one by one;
rows with a null doc_id count as one document too.  An empty table gives an empty result.  Other columns pass
through ``apply_bitmaps`` as they are, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import written

WORD = 63
_ROW, _ROW2, _WORDS, _DROPPED = "__line_row", "__line_doc", "__line_words", "__line_dropped"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), string.ascii_uppercase, string.ascii_lowercase)


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(0), F.coalesce(F.col(text_col), F.lit("")))


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, words, n_dropped) of each row that loses lines; words[i] has the bits of lines 63 i to 63 i + 62."""
    rows = docs.select(_row_key(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = rows.select("row", "doc_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    lines = lines.select("row", "doc_id", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    lines, _ = written(lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "row", "pos"), "lines")
    dealt = lines.select("h1", "h2", "doc_id", "pos").repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    first = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")) == 1
    frequent = dealt.select("h1", "h2", first.alias("first")).where("first").groupBy("h1", "h2").agg(F.count("*").alias("n"))
    frequent, _ = written(frequent.where(F.col("n") >= min_docs).select("h1", "h2"), "keys", narrow=True)
    gone = lines.join(frequent, ["h1", "h2"]).select("row", "doc_id", "pos").distinct()
    words = gone.groupBy("row", "doc_id", F.floor(F.col("pos") / WORD).cast("int").alias("at"))
    words = words.agg(F.expr(f"bit_or(shiftleft(1L, pos % {WORD}))").alias("bits"), F.count("*").alias("n"))
    packed = words.groupBy("row", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m"), F.max("at").alias("last"), F.sum("n").alias("n_dropped"))
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return packed.select("row", "doc_id", dense.alias("words"), "n_dropped")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with their remaining text; with ``report`` also n_lines and n_dropped."""
    maps = bitmaps.select(F.col("row").alias(_ROW), F.col("doc_id").alias(_ROW2), F.col("words").alias(_WORDS), F.col("n_dropped").alias(_DROPPED))
    left = docs.withColumn("__line_key", _row_key(id_col, text_col))
    both = left.join(maps, (F.col("__line_key") == F.col(_ROW)) & F.col(id_col).eqNullSafe(F.col(_ROW2)), "left")

    def stays(_line: Column, i: Column) -> Column:
        word = F.coalesce(F.get(F.col(_WORDS), F.floor(i / WORD).cast("int")), F.lit(0).cast("long"))
        return F.call_function("shiftright", word, i % WORD).bitwiseAND(1) == 0

    kept = F.when(F.col(_WORDS).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(F.filter(lines_of(F.col(text_col)), stays), "\n"))
    out = both.withColumn("__line_kept", kept)
    more = []
    if report:
        more = [F.size(lines_of(F.col(text_col))).cast("long").alias("n_lines"), F.coalesce(F.col(_DROPPED), F.lit(0)).cast("long").alias("n_dropped")]
    return out.select(*[F.col("__line_kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *more)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` without their frequent lines."""
    return apply_bitmaps(docs, line_bitmaps(docs, min_docs, min_chars, id_col, text_col), id_col, text_col, report)
