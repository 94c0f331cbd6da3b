"""Compiled stories: attributes, passages, bundled scripts and styles, and the plain-text source format.

A story is one file whose parts have offsets into it, so one task reads one file; a folder of stories is read in parallel.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.markup import decode_entities

PART = "path string, sha256 string, size long, part string, ord long, pid int, name string, tags array<string>, position string, passage_size string, block_kind string, block_id string, block_type string, block_role string, raw string, content string, content_offset long, offset long, body_start long, attributes map<string, string>"
_NAMES = [x.strip().split(" ")[0] for x in PART.replace("map<string, string>", "m").split(",")]
# Fixed values of the file format.
STORY, STORY_END = "<tw-storydata name=", "</tw-storydata>"
_PASSAGE = re.compile(r"<tw-passagedata\b([^>]*)>([\s\S]*?)</tw-passagedata>")
_BLOCK = re.compile(r"<(script|style)\b([^>]*)>([\s\S]*?)</\1>")
_SCRIPT = {("type", "text/twine-javascript"), ("id", "twine-user-script")}
_STYLE = {("type", "text/twine-css"), ("id", "twine-user-stylesheet")}
_HEADER = re.compile(r"/\*\s*twine-user-(?:script|stylesheet)\s*#\d+:\s*\"([^\"]+)\"\s*\*/")
_ATTRIBUTE = re.compile(r"([A-Za-z_][\w:.-]*)=\"([^\"]*)\"", re.A)


def attributes(tag: str) -> dict[str, str]:
    """Quoted attributes; the last of a name wins, and values stay encoded."""
    return dict(_ATTRIBUTE.findall(tag))


def attributes_column(tag: Column) -> Column:
    """The same as a map column; needs spark.sql.mapKeyDedupPolicy=LAST_WIN where names repeat."""
    pattern = r'([A-Za-z_][\w:.-]*)="([^"]*)"'
    return F.map_from_arrays(F.regexp_extract_all(tag, F.lit(pattern), F.lit(1)), F.regexp_extract_all(tag, F.lit(pattern), F.lit(2)))


def bundle_parts(inner: str, offset: int) -> list[tuple[str | None, str, int, int]]:
    """(file, content, offset, body start) of each file of a block, by header comments; without any, the block is one nameless part."""
    marks = list(_HEADER.finditer(inner))
    if not marks:
        return [(None, inner, offset, offset)]
    ends = [m.start() for m in marks[1:]] + [len(inner)]
    return [(m[1], inner[m.start() : e], offset + m.start(), offset + m.end()) for m, e in zip(marks, ends)]


def parse_story(path: str, html: str) -> list[dict]:
    """Rows of ``PART``: the story, its passages, scripts and styles."""
    start = html.find(STORY)
    if start < 0:
        raise ValueError(f"no story data found in {path}")
    body = html.find(">", start) + 1
    end = html.find(STORY_END, body)
    text = html[body : end if end >= 0 else len(html)]
    base = {"path": path, "sha256": hashlib.sha256(html.encode()).hexdigest(), "size": len(html.encode())}
    rows = [base | {"part": "story", "ord": 0, "offset": start, "attributes": attributes(html[start:body])}]
    blocks = []
    for m in _BLOCK.finditer(text):
        own = set(attributes(m[2]).items())
        part = "script" if own & _SCRIPT else "style" if own & _STYLE else None
        if part:
            blocks.append(m.span())
            head = attributes(m[2])
            block = {"part": part, "block_kind": m[1], "block_id": head.get("id"), "block_type": head.get("type"), "block_role": head.get("role")}
            rows += [base | block | {"name": f, "content": c, "offset": o, "body_start": b} for f, c, o, b in bundle_parts(m[3], body + m.start())]
    for m in _PASSAGE.finditer(text):
        if any(a <= m.start() < b for a, b in blocks):
            continue
        own = attributes(m[1])
        pid = own.get("pid")
        rows.append(base | {
            "part": "passage", "pid": int(pid) if pid and re.fullmatch(r"\s*-?\d+\s*", pid) else None, "name": own.get("name", ""), "tags": own.get("tags", "").split(), "position": own.get("position"), "passage_size": own.get("size"),
            "raw": m[2], "content": decode_entities(m[2]), "content_offset": body + m.start(2), "offset": body + m.start(),
        })
    return [r | {"ord": n} for n, r in enumerate(rows)]


def stories(files: DataFrame) -> DataFrame:
    """Rows of ``PART`` from files (path, text)."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, t in zip(frame["path"], frame["text"]) for r in parse_story(p, t or "")]
            out = pd.DataFrame(rows, columns=_NAMES, dtype=object)
            yield out.where(out.notna(), None)

    return files.select("path", "text").mapInPandas(parse, PART)


def read_story(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``PART`` of a story or a folder of stories; a path that isn't there is an error that names it."""
    if not path:
        raise ValueError("no path of a story given")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        raise FileNotFoundError(f"no story at {path}")
    text = spark.read.text(path, wholetext=True)
    return stories(text.select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def plain_view(parts: DataFrame) -> DataFrame:
    """What a plain reader shows of each part: no hash and no offsets of contents, but a block's kind, id, type and role and a passage's size."""
    return parts.select("path", "part", "ord", "pid", "name", "tags", "position", F.col("passage_size").alias("size"), F.col("block_kind").alias("kind"), F.col("block_id").alias("id"), F.col("block_type").alias("type"), F.col("block_role").alias("role"), "raw", "content", "offset")


def passages(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'passage'").select(F.col("ord").alias("passage_ord"), "pid", "name", "tags", "content", "content_offset")


def by_name(rows: DataFrame) -> DataFrame:
    """Passages by name; the last of a name wins."""
    w = Window.partitionBy("name").orderBy(F.desc("passage_ord"))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def by_tag(rows: DataFrame) -> DataFrame:
    """(tag, name, passage_ord) of each tag of each passage."""
    return rows.select(F.explode("tags").alias("tag"), "name", "passage_ord")


_TITLE = r"^::[ \t]*(.+?)[ \t]*(?:\[([^\]]*)\])?[ \t]*(?:\{[^}]*\})?[ \t]*$"


def parse_source(files: DataFrame) -> DataFrame:
    """Passages (file, line, name, tags, raw) of plain-text sources (file, text): a title line opens a passage, all lines up to the next belong to it.

    The number of titles so far, a running sum over a file's lines, says which passage a line is of.
    """
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    title = F.col("line").rlike(_TITLE)
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("is_title", title).withColumn("group", F.sum(title.cast("int")).over(w)).where("group > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_title"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    head = F.max(F.when(F.col("is_title"), F.struct("pos", "line")))
    out = lines.groupBy("file", "group").agg(head.alias("head"), body.alias("raw"))
    tags = F.filter(F.split(F.regexp_extract("head.line", _TITLE, 2), r"[ \t]+"), lambda t: t != "")
    return out.select("file", (F.col("head.pos") + 1).alias("line"), F.trim(F.regexp_extract("head.line", _TITLE, 1)).alias("name"), tags.alias("tags"), "raw")
