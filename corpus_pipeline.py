"""From documents to tokens: five stages, each one an operator of the training-data subpackage.

Each stage takes all rows that its predecessor kept, and its decisions take effect: documents without a language go, lines that
stand in many documents go from the texts, of near copies one stays, documents are repeated by the weight of their source, and the
last stage returns the digests of their tokens.  run() applies the stages one after another, each written as a table in the shared
folder and read again.  n_chars follows the text wherever a stage changes it.

Defined results, in every stage: an empty table gives an empty result; columns beyond those of documents are left out, whatever their names;
rows that repeat are separate rows but where a stage says otherwise.  Nulls and ties are said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import small_batches, table, written
from textloom.llm.language_id import UNKNOWN, held_out, identify, learn
from textloom.llm.line_dedup import line_dedup
from textloom.llm.mixing import mix_sources
from textloom.llm.piece_bpe import encode_texts
from textloom.llm.queries import piece_model_path
from textloom.llm.simhash import near_copies

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go.  Without any language to learn, all texts stand for one.

    A null text has no letter.  Null ids and sources pass; a null lang is not learned from.  Languages that score alike: the result is the same, the document stays.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    known = learn(docs.where(~held_out()))
    if not any(v.any() for v in known.values()):
        known = learn(docs.withColumn("lang", F.lit("any")))
    return identify(docs, known, name="language").where(F.col("language.lang_pred") != UNKNOWN).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines whose key stands in at least 10 documents.

    A null text becomes an empty one.  Rows of one id count as one document, as do those without an id.
    """
    kept = line_dedup(docs.select(*COLUMNS), min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more, by SimHash groups and, beyond their reach, MinHash bands.

    The least id of a group stays, null ids last; of rows with the same id and text one stays.  A null text counts as empty.
    """
    small_batches(spark)
    return near_copies(docs.select(*COLUMNS), words=5, least_similarity=0.8).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources at the same weight, as many rows as there are documents on average; copies keep their doc_id.

    A null source is a source of its own; rows of one id, null included, have the same count.
    """
    return mix_sources(docs.select(*COLUMNS), seed=1, copy_col=None).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the tokens of each copy and of what they decode to, a row for each row.  A null text counts as empty."""
    small_batches(spark)
    out = encode_texts(docs.select("doc_id", "text"), piece_model_path())
    return out.select("doc_id", "tokens.n_tokens", "tokens.ids_sha256", "tokens.decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("lines", line_stage),
    ("copies", copies_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]
ORACLE_SQL: str | None = None  # hyperdimensional vectors, fingerprints and merges are beyond SQL; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
