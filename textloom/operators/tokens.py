"""Tokens as rows: one per token, flat columns, so that nothing nested is passed between Python and the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import markup as mk
from textloom.functions.batches import pieces

TOKEN = "ord int, kind string, start int, end int, name string, closing boolean"


def token_rows(passages: DataFrame, key: str, text: str, with_text: bool = False) -> DataFrame:
    """(key, ord, kind, start, end, name, closing[, text]) of each token; starts and ends are code points."""
    kind = dict(passages.dtypes)[key]
    columns = [key, *(x.split(" ")[0] for x in TOKEN.split(", "))] + ["text"] * with_text

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames, "__text"):
            out: list[list] = [[] for _ in columns]
            for k, t in zip(frame[key], frame["__text"]):
                found = mk.tokenize(t if isinstance(t, str) else "")
                parts = [[k] * len(found), range(len(found)), [x.kind for x in found], [x.start for x in found], [x.end for x in found], [x.name for x in found], [x.closing for x in found]]
                for a, b in zip(out, [*parts, [x.text for x in found]]):
                    a.extend(b)
            yield pd.DataFrame({c: pd.Series(v, dtype=object) if c in ("kind", "name", "text", key) else v for c, v in zip(columns, out)})

    return passages.select(key, F.col(text).alias("__text")).mapInPandas(scan, f"{key} {kind}, {TOKEN}" + ", text string" * with_text)


def depth_rows(passages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, kind, depth) of each token: how many conditionals, loops and switches are open before it."""
    kind = dict(passages.dtypes)[key]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames, "__text"):
            rows = [(k, n, x.kind, d) for k, t in zip(frame[key], frame["__text"]) for found in [mk.tokenize(t if isinstance(t, str) else "")] for n, (x, d) in enumerate(zip(found, mk.depths(found)))]
            yield pd.DataFrame(rows, columns=[key, "ord", "kind", "depth"])

    return passages.select(key, F.col(text).alias("__text")).mapInPandas(scan, f"{key} {kind}, ord int, kind string, depth int")


def covered(tokens: DataFrame, passages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reversible): tokens follow each other without gaps from 0 to the text's end."""
    gap = F.col("start") != F.coalesce(F.lag("end").over(Window.partitionBy(key).orderBy("ord")), F.lit(0))
    spans = tokens.withColumn("gap", gap.cast("int")).groupBy(key).agg(F.sum("gap").alias("gaps"), F.max("end").alias("last"))
    both = passages.select(key, F.length(F.coalesce(text, F.lit(""))).alias("size")).join(spans, key, "left")
    return both.select(key, ((F.coalesce("gaps", F.lit(0)) == 0) & (F.coalesce("last", F.lit(0)) == F.col("size"))).alias("reversible"))


def macro_rows(passages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, name, closing, body) of each macro as the checks see them: print forms under one name, bodies not quote-aware."""
    pattern = r"<<\s*(/?)([A-Za-z_][A-Za-z0-9_-]*|=-?|-)([\s\S]*?)>>"
    parts = [F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    rows = passages.select(key, F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("slash", "name", "body"))])).alias("ord", "m"))
    name = F.when(F.col("m.name").isin("=", "-", "=-"), "print").otherwise(F.lower("m.name"))
    return rows.select(key, "ord", name.alias("name"), (F.col("m.slash") == "/").alias("closing"), F.col("m.body").alias("body"))


def display_items(passages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, kind, value) of what a plain reader would translate: text with words, link labels and macro labels, in order."""
    kind = dict(passages.dtypes)[key]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in pieces(frames, "__text"):
            rows = []
            for k, t in zip(frame[key], frame["__text"]):
                n = 0
                for x in mk.tokenize(t if isinstance(t, str) else ""):
                    label = mk.link_label(x) if x.kind == "link" else mk.macro_label(x) if x.kind == "macro" and not x.closing else None
                    value = x.text.strip() if x.kind == "text" else label.text if label else ""
                    if mk.has_word(value):
                        rows.append((k, n, {"text": "text", "link": "link_label"}.get(x.kind, "macro_label"), value))
                        n += 1
            yield pd.DataFrame(rows, columns=[key, "ord", "kind", "value"], dtype=object)

    return passages.select(key, F.col(text).alias("__text")).mapInPandas(scan, f"{key} {kind}, ord int, kind string, value string")


def analyze_pairs(pairs: DataFrame, samples: int = 25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, codes, samples) of tiered findings over pairs (where_, pos, source, target); pairs with a null side aren't checked.

    totals: checked, clean, with_findings and for each tier its findings and its entries.  codes: code, tier, n.  samples: at most
    ``samples`` rows a code, in the order of (where_, pos).
    """
    from textloom.functions import columns as tc

    rows = pairs.where("source IS NOT NULL AND target IS NOT NULL").withColumn("f", tc.tiers("source", "target"))
    tiers = ("hard", "structural", "soft", "manual")
    has = [F.filter("f", (lambda tier: lambda x: x["tier"] == tier)(t)) for t in tiers]
    totals = rows.agg(
        F.count("*").alias("checked"), F.count(F.when(F.size("f") == 0, 1)).alias("clean"), F.count(F.when(F.size("f") > 0, 1)).alias("with_findings"),
        *[F.coalesce(F.sum(F.size(h)), F.lit(0)).alias(f"{t}_findings") for t, h in zip(tiers, has)], *[F.count(F.when(F.size(h) > 0, 1)).alias(f"{t}_entries") for t, h in zip(tiers, has)],
    )
    each = rows.select("where_", "pos", "source", "target", F.explode("f").alias("x")).select("where_", "pos", F.substring("source", 1, 160).alias("source"), F.substring("target", 1, 160).alias("target"), "x.*")
    codes = each.groupBy("code", "tier").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("code").orderBy("where_", "pos"))
    return totals, codes, each.withColumn("nth", nth).where(F.col("nth") <= samples)


FIELDS, SETS = ("id", "persistence", "argument", "branch", "output"), ("reads", "writes")


def equivalent(signatures: DataFrame, pairs: DataFrame, max_broadcast: int = 10_000) -> DataFrame:
    """``pairs`` (a, b and more) with ``same``: both names known, every field alike, and the same sets read and written.

    signatures: name, FIELDS as strings, SETS as lists of strings; which macros there are and what they do is the caller's knowledge.  A name's
    signature is one digest of all that, so only digests meet the pairs: by broadcast if a count bounds them, else by a shuffle.
    """
    whole = F.sha2(F.to_json(F.struct(*FIELDS, *[F.array_sort(c).alias(c) for c in SETS]), {"ignoreNullFields": "false"}), 256)
    digests = signatures.groupBy("name").agg(F.min(whole).alias("sign"))
    if digests.limit(max_broadcast + 1).count() <= max_broadcast:
        digests = F.broadcast(digests)
    both = pairs.join(digests.select(F.col("name").alias("a"), F.col("sign").alias("x")), "a", "left").join(digests.select(F.col("name").alias("b"), F.col("sign").alias("y")), "b", "left")
    return both.select(*pairs.columns, F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same"))


def bag_deltas(bags: DataFrame, key: str) -> DataFrame:
    """(key, word, n) of each word whose count differs between the bags a and b of a row, n being how many more b has; counts are summed in part
    before the shuffle, so long bags cost no more than their words."""
    words = bags.select(key, F.explode("a").alias("word"), F.lit(-1).alias("n")).unionByName(bags.select(key, F.explode("b").alias("word"), F.lit(1).alias("n")))
    return words.groupBy(key, "word").agg(F.sum("n").alias("n")).where("n != 0")
