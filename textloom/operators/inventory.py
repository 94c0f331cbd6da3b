"""The unit inventory of a story: scan, statistics, issues, identifier space, fingerprint."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import columns as tc
from textloom.functions import markup as mk
from textloom.functions import scan
from textloom.functions.batches import pieces

SCANNED = (
    "struct<units: array<struct<kind: string, start_offset: int, end_offset: int, raw_text: string, protected_text: string, "
    f"placeholders: {tc.MARKS_TYPE}, risk_level: string, origin: string, context: string>>, "
    "issues: array<struct<code: string, host: string, offset: int, detail: string>>, code_blocks: int, code_strings: int, reversible: boolean>"
)
# Unit fields that are always null, or always the same, in an inventory.
CONSTANT = {"source_file": None, "widget": None, "base_relation": None, "old_translation": None, "translation": None}


def _pieces(parts: Iterable[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Columns a and b of batches, in pieces by the size of the texts in b."""
    return pieces((pd.DataFrame({"a": a, "b": b}) for a, b in parts), "b")


def _identifiers(passages: DataFrame) -> DataFrame:
    @F.pandas_udf("array<string>")
    def keys(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for frame in _pieces(parts):
            yield pd.Series([sorted(mk.lookup_keys(n or "", t or "")) for n, t in zip(frame["a"], frame["b"])], dtype=object)

    return passages.select(F.explode(keys("name", "content")).alias("key")).distinct()


def identifier_space(passages: DataFrame) -> DataFrame:
    """Distinct lower-cased keys that passages (name, content) look up: names, link targets, data keys, calls, cases, comparisons."""
    return _identifiers(passages)


def scan_passages(passages: DataFrame) -> DataFrame:
    """``passages`` (passage_ord, pid, name, tags, content, content_offset) with a struct ``scan``.

    A literal that is also a key isn't exported, and whether it is decides where runs of text end.  So each passage's literals
    meet the identifier space first, as rows, and only those found come back to the passage as a list.
    """

    @F.pandas_udf("array<string>")
    def literals(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frame in _pieces((t, t) for t in texts):
            yield pd.Series([sorted(scan.literal_keys(t or "")) for t in frame["b"]], dtype=object)

    @F.pandas_udf(SCANNED)
    def scanned(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for frame in _pieces((known, texts) for texts, known in parts):
            rows = [scan.scan_passage(t or "", set(k) if k is not None else set()) for k, t in zip(frame["a"], frame["b"])]
            yield pd.DataFrame({"units": [r.units for r in rows], "issues": [r.issues for r in rows], "code_blocks": [r.code_blocks for r in rows], "code_strings": [r.code_strings for r in rows], "reversible": [r.reversible for r in rows]})

    wanted = passages.select("passage_ord", F.explode(literals("content")).alias("key"))
    known = wanted.join(_identifiers(passages), "key").groupBy("passage_ord").agg(F.collect_set("key").alias("known"))
    return passages.join(known, "passage_ord", "left").withColumn("scan", scanned("content", "known")).drop("known")


def units(scanned: DataFrame, source_version: str = "unknown") -> DataFrame:
    """One row per unit in inventory order (passage_ord, unit_ord); the first claim of a span wins."""
    rows = scanned.select("passage_ord", "pid", F.col("name").alias("passage"), "tags", "content_offset", F.posexplode("scan.units").alias("unit_ord", "u"))
    rows = rows.select("passage_ord", "unit_ord", "pid", "passage", tc.area(F.col("tags"), F.col("passage")).alias("family"), "content_offset", "u.*")
    rows = rows.withColumn("unit_id", F.concat(F.coalesce(F.col("pid").cast("string"), F.lit("undefined")), F.lit(":"), "start_offset", F.lit("-"), "end_offset"))
    claim = Window.partitionBy("unit_id").orderBy("passage_ord", "unit_ord")
    rows = rows.withColumn("claim", F.row_number().over(claim)).withColumn("first_kind", F.first("kind").over(claim))
    rows = rows.withColumn("abs_start", F.col("content_offset") + F.col("start_offset")).withColumn("abs_end", F.col("content_offset") + F.col("end_offset"))
    fixed = {k: F.lit(v).cast("string") for k, v in CONSTANT.items()}
    return rows.withColumns(fixed | {"visibility": F.lit("player"), "qa_status": F.lit("pending"), "source_version": F.lit(source_version), "rule_hits": F.array().cast("array<string>")})


def issues(scanned: DataFrame, claimed: DataFrame | None = None, most: int = 500) -> DataFrame:
    """Issues by (code, host): their count and their first occurrence; the first ``most`` groups by first occurrence."""
    rows = scanned.select("passage_ord", F.col("name").alias("passage"), F.posexplode("scan.issues").alias("n", "i")).select("passage_ord", "n", "passage", "i.*")
    if claimed is not None:
        again = claimed.where("claim > 1").select("passage_ord", F.col("unit_ord").alias("n"), "passage", F.lit("duplicate-unit-span").alias("code"), F.col("unit_id").alias("host"), F.col("start_offset").alias("offset"), F.concat("kind", F.lit(" vs "), "first_kind").alias("detail"))
        rows = rows.unionByName(again)
    first = F.min_by(F.struct("passage", "offset", "detail"), F.struct("passage_ord", "n"))
    groups = rows.groupBy("code", "host").agg(F.count("*").alias("count"), first.alias("f"), F.min(F.struct("passage_ord", "n")).alias("at"))
    return groups.orderBy("at").limit(most).select("code", "host", "f.passage", "f.offset", "f.detail", "count")


def histograms(rows: DataFrame) -> DataFrame:
    """Units by kind, risk and area in one pass: (facet, value, n)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in (("kind", "kind"), ("risk", "risk_level"), ("area", "family"))]))
    return rows.select(pairs.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def inventory_fingerprint(rows: DataFrame) -> DataFrame:
    """sha256 over the sorted lines unit_id NUL protected_hash, 32 hex digits.

    The lines of an inventory are one string by definition, so one task reads them all.  They are sorted and packed by ranges before, in many tasks;
    what the one task sorts is a row for each batch of lines, by its first line, and it holds one of them unpacked.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, frame in enumerate(f for f in frames if len(f)):
            yield pd.DataFrame({"first": [frame["line"].iat[0]], "n": [n], "data": [zlib.compress("\n".join(frame["line"]).encode(), 1)]})

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, lead = hashlib.sha256(), b""
        for frame in frames:
            for x in frame["data"]:
                total.update(lead)
                total.update(zlib.decompress(x))
                lead = b"\n"
        yield pd.DataFrame({"fingerprint": ["sha256:" + total.hexdigest()[:32]]})

    line = F.concat("unit_id", F.lit("\0"), tc.protected_hash(F.col("protected_text")))
    packed = rows.select(line.alias("line")).repartitionByRange("line").sortWithinPartitions("line").mapInPandas(pack, "first string, n long, data binary")
    return packed.repartition(1).sortWithinPartitions("first", "n").mapInPandas(digest, "fingerprint string")
