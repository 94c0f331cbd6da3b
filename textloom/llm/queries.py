"""The registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.html_text import extract_html
from textloom.llm.language_id import held_out, identify, learn
from textloom.llm.lattice_dedup import lattice_dedup
from textloom.llm.line_dedup import line_dedup
from textloom.llm.mixing import PART, STEPS, mix_sources
from textloom.llm.mtree_search import mtree_search
from textloom.llm.ordinal_quality import MAX_TRAIN, fit, score
from textloom.llm.piece_bpe import encode_texts
from textloom.llm.simhash import simhash_groups
from textloom.llm.suffix_dedup import suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.small_batches(spark)
    return common.table(spark, sf_dir, name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), length=50)


def op2_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    known = learn(docs.where("NOT held_out"))
    return identify(docs.drop("lang"), known).select("doc_id", "held_out", "language.lang_pred", "language.score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_docs=10, min_chars=1, report=True).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def piece_model_path() -> str:
    """The vocabulary file of the 32k BPE model, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, piece_model_path()).select("doc_id", "tokens.n_tokens", "tokens.ids_sha256", "tokens.decoded_sha256")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, seed=1).select("doc_id", "source", "copy", "text")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), words=3, bits=2)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_html(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 neither toxic nor of quality, 2 of quality and not toxic; ``keep`` selects what is likely of grade 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grade = F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality"))
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade")), n_grades=3, max_train=MAX_TRAIN)
    out = score(docs, model, n_grades=3, tail=2)
    return out.select("doc_id", "quality.expected_grade", "quality.tail_prob", (F.col("quality.tail_prob") >= 0.5).alias("keep"))


def op10_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_lattice_dedup": op2_lattice_dedup,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_piece_bpe": op5_piece_bpe,
    "op6_source_mix": op6_source_mix,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_html_text": op8_html_text,
    "op9_ordinal_quality": op9_ordinal_quality,
    "op10_mtree_search": op10_mtree_search,
}

_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def line_sql(docs: str, min_docs: int = 10, min_chars: int = 1) -> str:
    """Common table expressions; line_kept has doc_id, n_lines, n_dropped and kept of each row of ``docs``."""
    return f"""
line_rows AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
line_all AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], {_STRIP}), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS k
             FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM line_rows)),
line_hot AS (SELECT k FROM (SELECT DISTINCT doc_id, k FROM line_all) WHERE length(k) >= {min_chars} GROUP BY k HAVING count(*) >= {min_docs}),
line_kept AS (SELECT doc_id, count(*) AS n_lines, count(h.k) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE h.k IS NULL), '') AS kept
              FROM line_all a LEFT JOIN line_hot h ON a.k = h.k GROUP BY doc_id)"""


def mix_sql(docs: str, seed: int = 1) -> str:
    """Common table expressions; mix_out has doc_id, source and copy of each copy of a row of ``docs``."""
    return f"""
mix_n AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
mix_mean AS (SELECT source, CAST(1.0 AS DOUBLE) * (SELECT sum(n) FROM mix_n)::DOUBLE / ((SELECT count(*) FROM mix_n)::DOUBLE * n::DOUBLE) AS mean FROM mix_n),
mix_part AS (SELECT source, greatest(1, ceil(mean / {PART}))::INT AS parts, mean / greatest(1, ceil(mean / {PART})) AS part FROM mix_mean),
mix_cdf AS (SELECT * FROM (
    WITH RECURSIVE steps AS (
        SELECT source, parts, part, 0 AS k, exp(-part) AS p, exp(-part) AS c FROM mix_part
        UNION ALL
        SELECT source, parts, part, k + 1, p * part / (k + 1), c + p * part / (k + 1) FROM steps WHERE k < {STEPS - 1})
    SELECT * FROM steps)),
mix_u AS (SELECT d.doc_id, d.source, j,
                 (CAST('0x' || substr(md5('{seed}|' || coalesce(d.doc_id::VARCHAR, 'null') || '|' || j::VARCHAR), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
          FROM (SELECT d.doc_id, d.source, unnest(range(1, r.parts + 1)) AS j FROM {docs} d JOIN mix_part r ON d.source IS NOT DISTINCT FROM r.source) d),
mix_count AS (SELECT u.doc_id, u.source, count(*) AS n FROM mix_u u JOIN mix_cdf c ON u.source IS NOT DISTINCT FROM c.source AND c.c < u.u GROUP BY u.doc_id, u.source),
mix_out AS (SELECT doc_id, source, unnest(range(1, n + 1))::INT AS copy FROM mix_count)"""


ORACLES: dict[str, str] = {
    "op4_line_dedup": f"WITH {line_sql('documents')} SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM line_kept",
    "op10_mtree_search": """
        WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
                   FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0),
             r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op6_source_mix": f"WITH {mix_sql('documents')} SELECT m.doc_id, m.source, m.copy, d.text FROM mix_out m JOIN documents d ON m.doc_id = d.doc_id",
}
