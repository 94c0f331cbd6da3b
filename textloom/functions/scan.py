"""Units and issues of one passage, from its tokens."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from textloom.functions import markup as mk

# What counts as left-over markup, as code, and as the name of something shown.
RESIDUE = re.compile(r"<<|>>|\[\[|\]\]|<[A-Za-z/]|(?<![\w$])[$_][A-Za-z_]")
CODE_SIGNS = re.compile(r"[=\[\]{}<>+]")
CODE_START = re.compile(r"\s*[$_.#\"']")
CSS_CALL = re.compile(r"\b[a-z-]+\([^)]*(?:deg|px|em|rem|%|rgba?|hsla?|url|calc)\b", re.I | re.A)
BRACKETED_LABEL = re.compile(r"[-+0-9A-Za-z£$][^()?=$_,]*\([^()?=$_,]*\)[.!?…]?")
ASSIGNED_TO = re.compile(r"\s*(?:set|unset|run|capture|init|remember|forget)\s+([A-Za-z_$][\w$.\[\]\"']*)\s+(?:to|\+=|-=|=)\s*", re.A)
SHOWN_NAME = re.compile(r"text|texts|string|strings|str|desc|descs|description|label|labels|message|messages|caption|title|journal|hint|prompt|note|reason|name", re.I)
JS_CONTEXT = {'"': "js-double", "'": "js-single", "`": "js-template"}
ARG_CONTEXT = {'"': "arg-double", "'": "arg-single"}


@dataclass
class Found:
    units: list[dict] = field(default_factory=list)
    issues: list[dict] = field(default_factory=list)
    code_blocks: int = 0
    code_strings: int = 0
    reversible: bool = True


def shown(text: str, size: int) -> str:
    return json.dumps(text[:size], ensure_ascii=False)


def code_shaped(text: str) -> bool:
    """Plumbing rather than prose: operators, selectors, style functions, calls."""
    return bool(CODE_SIGNS.search(text) or CODE_START.match(text) or CSS_CALL.search(text)) or bool(re.search(r"[()]", text)) and not BRACKETED_LABEL.fullmatch(text.strip())


def export_rule(token: mk.Token, hit: mk.Literal, shown_target: bool, known: set[str]) -> bool:
    """Is a literal of this element text that a player sees?"""
    fresh = hit.text.strip().lower() not in known
    plain = mk.reads_as_argument(hit.text) and not code_shaped(hit.text) and fresh
    if hit.key is not None:
        return hit.key in mk.DISPLAY_KEYS or shown_target and plain
    if token.kind == "macro" and token.name in mk.OUTPUT_MACROS or hit.markup:
        return True
    return plain and (token.name or "") not in mk.CONTROL_MACROS | mk.NAMING_MACROS


def literal_keys(text: str) -> set[str]:
    """Lower-cased literals of a passage's code: what has to be looked up among the keys before it is scanned."""
    out = set()
    for t in mk.tokenize(text):
        if t.kind == "code" or t.kind == "macro" and not t.closing:
            out |= {h.text.strip().lower() for h in mk.display_literals(text, *t.body)}
    return out


def scan_passage(text: str, known: set[str]) -> Found:
    """``known`` holds those of the passage's literals that are keys somewhere in the story."""
    out = Found()
    tokens = mk.tokenize(text)
    if not mk.joins_up(text, tokens):
        out.reversible = False
        return out
    nesting = mk.depths(tokens)

    def issue(code: str, offset: int, detail: str, host: str = "") -> None:
        out.issues.append({"code": code, "host": host, "offset": offset, "detail": detail})

    def unit(kind: str, start: int, end: int, protected: str, marks: list[dict], risk: str, origin: str | None = None, context: str | None = None) -> None:
        if mk.has_word(mk.payload(protected, marks)):
            out.units.append({"kind": kind, "start_offset": start, "end_offset": end, "raw_text": text[start:end], "protected_text": protected, "placeholders": marks, "risk_level": risk, "origin": origin, "context": context})

    def label(kind: str, x: mk.Label, nested: bool, origin: str, context: str | None) -> None:
        inner = mk.literal_tokens(x.text)
        protected, marks = mk.protect(inner) if mk.joins_up(x.text, inner) else (x.text, [])
        unit(kind, x.start, x.end, protected, marks, "L2" if nested else "L1", origin, context)

    def risk_of(nested: int, marks: list[dict]) -> str:
        return "L2" if nested else "L1" if marks else "L0"

    run: list[int] = []

    def close_run() -> None:
        if not run:
            return
        part = [tokens[k] for k in run]
        protected, marks = mk.protect(part)
        bare = mk.payload(protected, marks)
        if mk.has_word(bare):
            if RESIDUE.search(bare):
                issue("passage-text-unparsed", part[0].start, shown(bare, 80), "text")
            else:
                unit("passage_text", part[0].start, part[-1].end, protected, marks, risk_of(nesting[run[0]], marks))
        run.clear()

    for i, t in enumerate(tokens):
        opens = t.kind == "macro" and not t.closing
        carries_code = t.kind == "code" or opens
        if t.kind == "code":
            out.code_blocks += 1
            if not t.closed:
                issue("code-block-unterminated", t.start, "no <</script>> found")
        elif opens and t.fallback and t.name in mk.CODE_MACROS:
            issue("macro-scan-fallback", t.start, "unterminated string inside macro")
        own_label = mk.macro_label(t) if opens else None
        inner_labels = [x for x in mk.inner_link_labels(text, *t.body) if mk.is_label_text(x.text)] if opens else []
        claimed = [(x.start, x.end) for x in [*inner_labels, *([own_label] if own_label else [])]]
        target = ASSIGNED_TO.match(text[t.body[0] : t.body[1]]) if carries_code else None
        hits = []
        for hit in mk.display_literals(text, *t.body) if carries_code else []:
            if any(a <= hit.inner[0] and hit.inner[1] <= b for a, b in claimed):
                continue
            if export_rule(t, hit, bool(target and SHOWN_NAME.search(target[1])), known):
                hits.append(hit)
            else:
                issue("unexported-code-string", hit.inner[0], shown(hit.text, 80), f"{t.name or t.kind}{'' if hit.key is None else ':' + hit.key}")
        edge = t.kind in ("comment", "code", "link") or t.kind == "macro" and t.name in mk.FLUSH_MACROS
        if t.kind == "html":
            m = re.match(r"</?([A-Za-z][A-Za-z0-9]*)", t.text)
            edge = bool(m) and m[1].lower() in mk.BLOCK_TAGS
        if not (edge or hits or inner_labels):
            run.append(i)
            continue
        close_run()
        for hit in hits:
            inner = mk.literal_tokens(hit.text)
            if not mk.joins_up(hit.text, inner):
                issue("code-string-irreversible", hit.inner[0], shown(hit.text, 60))
                continue
            protected, marks = mk.protect(inner)
            bare = mk.payload(protected, marks)
            if not mk.has_word(bare):
                continue
            if RESIDUE.search(bare):
                issue("code-string-unparsed", hit.inner[0], shown(bare, 80), t.name or t.kind)
            elif hit.text.strip().lower() in known:
                issue("code-string-is-identifier", hit.inner[0], shown(hit.text, 60), t.name or t.kind)
            else:
                unit("passage_text", *hit.inner, protected, marks, risk_of(nesting[i], marks), "code-string", JS_CONTEXT[hit.quote])
                out.code_strings += 1
        for x in inner_labels:
            label("link_label", x, nesting[i] > 0, "macro-link-label", JS_CONTEXT[x.quote] if x.quote else "link")
        if t.kind == "link" and (x := mk.link_label(t)) and mk.is_label_text(x.text):
            label("link_label", x, nesting[i] > 0, "link-markup", "link")
        elif t.kind == "macro" and (x := mk.macro_label(t)) and mk.is_label_text(x.text):
            label("macro_label", x, nesting[i] > 0, "macro-label", ARG_CONTEXT[x.quote])
    close_run()
    return out
