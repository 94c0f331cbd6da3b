"""Column functions that stay in the JVM, and the few that need Python behind Arrow."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import markup as mk
from textloom.functions import structure as st

MARK = "\u0001"
ENTITY = r"&[a-zA-Z][a-zA-Z0-9]*;|&#\d+;|&#x[0-9a-fA-F]+;"
PLACEHOLDER = f"{mk.OPEN}\\d+{mk.SHUT}"
SPACE = r"[\s\x{feff}]+"
NORMAL_SIGNS, IDENTITY_SIGNS = f"[<&{mk.OPEN}]|/\\*", f"[<&{mk.OPEN}]|/%|\\[\\[|\\]\\]|>>"  # what the patterns of these two rules need to match at all


def fold(c: Column) -> Column:
    """White space of any kind to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"(?U){SPACE}", " "))


def is_blank(c: Column) -> Column:
    """Nothing is left of it when it is folded."""
    return ~c.rlike(r"(?U)[^\s\x{feff}]")


def normalize_source(c: Column) -> Column:
    """What a text says, whatever its position: comments gone, macros and placeholders to marks, tags and references to spaces.

    ``c`` is read several times, so it should be a column: texts without the signs, or with no white space but single spaces, take the short way.
    """
    made = c
    for pattern, by in ((r"<!--[\s\S]*?-->", " "), (r"/\*[\s\S]*?\*/", " "), (r"<<[\s\S]*?>>", MARK * 2), (r"<[^>]+>", " "), (ENTITY, " "), (PLACEHOLDER, MARK * 2)):
        made = F.regexp_replace(made, pattern, by)
    return F.when(c.rlike(NORMAL_SIGNS), fold(made)).when(c.rlike(r"(?U)[\s\x{feff}&&[^ ]]|  "), fold(c)).otherwise(F.trim(c))


def digest(c: Column, n: int) -> Column:
    return F.substring(F.sha2(F.coalesce(c, F.lit("")), 256), 1, n)


def source_fingerprint(protected: Column) -> Column:
    return digest(normalize_source(F.coalesce(protected, F.lit(""))), 16)


def protected_hash(protected: Column) -> Column:
    return digest(protected, 24)


def unquoted(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, '"[^"]*"', '""'), "'[^']*'", "''")


def occurrences(c: Column, needle: Column) -> Column:
    """How often ``needle`` stands in ``c`` without overlaps; 0 for an empty one."""
    gone = F.length(c) - F.length(F.replace(c, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (gone / F.length(needle)).cast("int")).otherwise(0)


def replace_first(c: Column, needle: Column, by: Column) -> Column:
    at = F.instr(c, needle)
    return F.when((at > 0) & (F.length(needle) > 0), F.concat(F.substr(c, F.lit(1), at - 1), by, F.substr(c, at + F.length(needle)))).otherwise(c)


def placeholders(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({PLACEHOLDER})"), F.lit(1))


def bag_delta(a: Column, b: Column) -> Column:
    """(key, n) of each key whose count differs, n being how many more b has.  For short bags as placeholders are: each key is counted by itself."""
    keys = F.array_distinct(F.concat(a, b))
    counted = F.transform(keys, lambda k: F.struct(k.alias("key"), (F.size(F.filter(b, lambda x: x == k)) - F.size(F.filter(a, lambda x: x == k))).alias("n")))
    return F.filter(counted, lambda x: x["n"] != 0)


def restore(protected: Column, marks: Column) -> Column:
    """Placeholders filled in, one after another."""
    return F.aggregate(marks, protected, lambda text, m: F.replace(text, m["placeholder"], m["raw"]))


def payload(protected: Column, marks: Column) -> Column:
    return F.aggregate(marks, protected, lambda text, m: F.replace(text, m["placeholder"], F.lit(" ")))


def has_word(c: Column) -> Column:
    return c.rlike("[A-Za-z]{2,}")


def shows_english(c: Column) -> Column:
    """The plain readers' test: two words side by side, or one of four letters and more."""
    return c.rlike("[A-Za-z]{3,}") & (c.rlike("[A-Za-z]{2,}[ \\t][A-Za-z]{2,}") | c.rlike("(?<![A-Za-z0-9_])[A-Za-z]{4,}(?![A-Za-z0-9_])"))


def is_url(c: Column) -> Column:
    s = fold(c)
    host = r"(?i)^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:[a-z]{2,})(?:[/?#]\S*)?$"
    return (F.length(s) > 0) & ~s.rlike(r"\s") & (s.rlike(r"(?i)^(?:https?://|//)\S+$") | s.rlike(host))


def is_name(c: Column) -> Column:
    s = fold(c)
    return (F.length(s) == 0) | (~s.rlike(r"\s") & s.rlike(r"[$_.\[\]{}()]"))


def is_label_text(c: Column) -> Column:
    return ~is_url(c) & ~is_name(c) & has_word(c)


def is_identity(raw: Column) -> Column:
    """No letter is left when placeholders, link targets, macros, tags and references are taken out: nothing to translate."""
    s = raw  # texts without the signs are as they are
    for pattern in (r"/%[\s\S]*?%/", PLACEHOLDER, r"\|[^\]]*\]\]", r"\[\[[^\]]*\]\]", r"<<[\s\S]*?>>", r"<[^>]+>", ENTITY, r'"\s*"[^"]*"\s*>>'):
        s = F.regexp_replace(s, pattern, " ")
    return F.when(raw.rlike(IDENTITY_SIGNS), F.coalesce(raw.rlike("<</?script>>") | ~s.rlike("[A-Za-z]"), F.lit(True))).otherwise(F.coalesce(~raw.rlike("[A-Za-z]"), F.lit(True)))


def area(tags: Column, name: Column) -> Column:
    ui = "(?i)setting|option|menu|save|load|slot|panel|button|hud|footer|version|import|export|config"
    widget = F.coalesce(F.array_contains(tags, "widget"), F.lit(False)) | name.rlike("(?i)widget")
    return F.when(widget, "widgets").when(name.rlike(ui), "ui").otherwise("narrative")


def risk(depth: Column, n_placeholders: Column, label: Column | None = None) -> Column:
    lowest = F.lit("L0") if label is None else F.when(label, "L1").otherwise("L0")
    return F.when(depth > 0, "L2").when(n_placeholders > 0, "L1").otherwise(lowest)


def context_code(context: Column, source: Column, target: Column) -> Column:
    """The code of the first delimiter that the target brings into its enclosing syntax, or null."""

    def more(sign: str) -> Column:
        return occurrences(target, F.lit(sign)) > occurrences(source, F.lit(sign))

    link = more("|") | more("]]") | more("->") | more("<-") | more("][") | more("`")
    return (
        F.when(context.isNull() & (occurrences(target, F.lit("`")) % 2 == 1), "TEXT_BACKTICK_UNBALANCED")
        .when((context == "arg-double") & (more('"') | more(">>")), "MACRO_ARG_DELIMITER_INSERTED")
        .when((context == "arg-single") & (more("'") | more(">>")), "MACRO_ARG_DELIMITER_INSERTED")
        .when((context == "link") & link, "LINK_LABEL_DELIMITER_INSERTED")
    )


def escape_for(context: Column, c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for name, quote in (("js-double", '"'), ("js-single", "'"), ("js-template", "`")):
        out = F.when(context == name, F.replace(out, F.lit(quote), F.lit("\\" + quote))).otherwise(out)
    out = F.replace(out, F.lit("${"), F.lit("\\${"))
    lines = F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    out = F.when(context == "js-template", out).otherwise(lines)
    return F.when(context.isin("js-double", "js-single", "js-template"), out).otherwise(c)


def context_slices(content: Column, start: Column, end: Column, size: int = 160) -> tuple[Column, Column]:
    """The text before and after [start, end), code points from 0."""
    first = F.greatest(F.lit(0), start - size)
    return F.substr(content, first + 1, start - first), F.substr(content, end + 1, F.lit(size))


def pseudo(c: Column) -> Column:
    """Each run of ASCII letters gets an x: a translation that keeps all structure of plain text."""
    return F.regexp_replace(c, "[A-Za-z]+", "$0x")


def arrow(kind: str, maker: Callable = F.pandas_udf) -> Callable:
    """A pandas or Arrow UDF that is made at its first call, as its type can be read only once there is a session.

    It counts as nondeterministic, so that the planner neither copies it, and with it all that its arguments are made of, into the filters and columns
    that read its result, nor runs it once for each of them.
    """

    def keep(f: Callable) -> Callable:
        made: list = []

        def call(*columns) -> Column:
            if not made:
                made.append(maker(f, kind).asNondeterministic())
            return made[0](*columns)

        call.__doc__ = f.__doc__
        return call

    return keep


STRUCTURE_SIGNS = f"[<>\\[\\]$_{{}}`{mk.OPEN}{mk.SHUT}]"
MARKS_TYPE = "array<struct<placeholder: string, raw: string, kind: string, name: string>>"
FINDINGS_TYPE = "array<struct<code: string, detail: string>>"


def _marks(value) -> list[dict]:
    return [x if isinstance(x, dict) else x.asDict() for x in value] if value is not None else []


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


@arrow(FINDINGS_TYPE, F.arrow_udf)
def _verify(source: pa.Array, target: pa.Array, context: pa.Array, protected: pa.Array, target_protected: pa.Array, marks: pa.Array) -> pa.Array:
    """Null where all is null: most rows are settled before and come as such, so only the others become Python values."""
    columns = (source, target, context, protected, target_protected, marks)
    out: list = [None] * len(source)
    open_ = np.flatnonzero(np.any([np.asarray(c.is_valid()) for c in columns], axis=0))
    for n, s, t, x, p, q, m in zip(open_, *[c.take(pa.array(open_)).to_pylist() for c in columns]):
        out[n] = [{"code": c, "detail": d} for c, d in st.verify(s or "", t, x, p, q, _marks(m))]
    return pa.array(out, pa.list_(pa.struct([("code", pa.string()), ("detail", pa.string())])))


def verify(source: Column, target: Column, context: Column | None = None, protected: Column | None = None, target_protected: Column | None = None, marks: Column | None = None) -> Column:
    """Findings of a pair.  Rows without any structure sign are settled in the JVM; the rest go through the guard in Python."""
    none = F.lit(None).cast("string")
    context, protected, target_protected = (none if c is None else c for c in (context, protected, target_protected))
    marks = F.lit(None).cast(MARKS_TYPE) if marks is None else marks
    plain = F.coalesce(~source.rlike(STRUCTURE_SIGNS) & ~target.rlike(STRUCTURE_SIGNS), F.lit(False)) & target_protected.isNull() & (context.isNull() | context.isin("js-double", "js-single", "js-template"))
    empty = F.when(is_blank(target), F.struct(F.lit("EMPTY_TRANSLATION").alias("code"), F.lit("").alias("detail")))
    same = F.when(source == target, F.struct(F.lit("NO_OP").alias("code"), F.lit("").alias("detail")))
    cheap = F.filter(F.array(empty, same), lambda x: x.isNotNull())
    hard = _verify(*[F.when(~plain, c) for c in (source, target, context, protected, target_protected)], F.when(~plain, marks))
    nothing = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(d).alias("detail")) for c, d in st.verify("", None)])
    return F.when(plain, cheap).otherwise(F.coalesce(hard, nothing))


@arrow("array<struct<tier: string, code: string, detail: string>>")
def tiers(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([[{"tier": a, "code": b, "detail": c} for a, b, c in st.tiers(s or "", t or "")] for s, t in zip(source, target)], dtype=object)


@arrow("string")
def fingerprint(text: pd.Series) -> pd.Series:
    """Canonical structure of a text; its digest is the structural key."""
    return pd.Series([st.fingerprint(t if isinstance(t, str) else "") for t in text], dtype=object)


@arrow("string")
def decode_entities(text: pd.Series) -> pd.Series:
    return pd.Series([mk.decode_entities(t) if isinstance(t, str) else None for t in text], dtype=object)


@arrow("array<struct<kind: string, start: int, end: int, text: string, name: string, closing: boolean>>")
def tokens(text: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": t.kind, "start": t.start, "end": t.end, "text": t.text, "name": t.name, "closing": t.closing} for t in mk.tokenize(x if isinstance(x, str) else "")] for x in text], dtype=object)


@arrow("array<string>")
def macro_names(text: pd.Series) -> pd.Series:
    return pd.Series([st.macro_names(x if isinstance(x, str) else "") for x in text], dtype=object)


@arrow("array<string>")
def link_targets(text: pd.Series) -> pd.Series:
    return pd.Series([mk.link_targets(x if isinstance(x, str) else "") for x in text], dtype=object)


@arrow("array<string>")
def variables(text: pd.Series) -> pd.Series:
    return pd.Series([st.variables(x if isinstance(x, str) else "") for x in text], dtype=object)


@arrow("array<string>")
def template_holes(text: pd.Series) -> pd.Series:
    return pd.Series([st.holes(x if isinstance(x, str) else "") for x in text], dtype=object)


@arrow("array<string>")
def tags(text: pd.Series) -> pd.Series:
    """Tags outside macros, as open, close or self and the name."""
    return pd.Series([st.tags(x) if isinstance(x, str) else [] for x in text], dtype=object)
