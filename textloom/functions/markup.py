"""Scanner for passage markup: macros, links, tags, variables, comments, code blocks and the text between them.

Offsets are code points.  ``tokenize`` covers its input without gaps or overlaps, so joining the tokens gives the input back.
Everything here is a pure function of strings and runs inside Arrow functions, one call for each passage.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

# Fixed values of the markup: which macros and tags end a run of text, take a label, hold code or print.
FLUSH_MACROS = set("set if elseif else for while = script widget init capture run audio goto display include endif endfor endwhile endscript endcapture endwidget switch case default break endswitch once endonce timed link linkappend linkprepend linkreplace button cycle listbox option textbox checkbox radiobutton note tooltip".split())
LABEL_MACROS = set("link linkappend linkprepend linkreplace button note tooltip option".split())
CODE_MACROS = set("set unset capture remember forget run init".split())
OUTPUT_MACROS = {"print", "=", "-"}
BLOCK_TAGS = set("div p table tbody thead tr td th ul ol li h1 h2 h3 h4 h5 h6 blockquote section article header footer form select option textarea pre style script center fieldset nav aside main figure".split())
CONTROL_MACROS = set("if elseif else unless case switch while for default break return continue".split())
NAMING_MACROS = set("goto display include widget npc npcappend npcselect npcincr unset pass image audio addinlineevent storeon earnfeat wearprop add_link".split())
DISPLAY_KEYS = set("sentence start end name lockedmessage description desc desc1 desc2 text label title message hint name_cap journal journalname pretext posttext caption note warning error".split())
DECIDING_WORDS = set("case is isnot eq neq gt gte lt lte and or not in typeof instanceof === !== == != <= >= < >".split())
NAMING_CALLS = set("includes startswith endswith indexof lastindexof search match matchall test split replace replaceall localecompare charat slice substring getelementbyid getelementsbyclassname queryselector queryselectorall getattribute setattribute addeventlistener createelement parseint parsefloat json".split())
DATA_KEYS = set("type variable key name_lower startpassage endpassage passage passages id tag tags short colour color style class icon pattern".split())
KEY_CALLS = "includes startswith endswith indexof lastindexof has get delete push unshift remove add".split()
NAMED_BY = "goto display include widget npc npcappend npcselect npcincr wearprop earnfeat pass image audio addinlineevent add_link storeon unset".split()
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}

OPEN, SHUT = "\u27e6", "\u27e7"
_DQ, _SQ, _BQ = r'"(?:[^"\\]|\\[\s\S])*+"', r"'(?:[^'\\]|\\[\s\S])*+'", r"`(?:[^`\\]|\\[\s\S])*+`"
_VARIABLE = r"[$_][A-Za-z_][A-Za-z0-9_$]*(?:\.[A-Za-z_][A-Za-z0-9_$]*|\[[^\]\n]*\])*"
_INNER_APOSTROPHE = r"(?<=[A-Za-z0-9_$])'(?=[A-Za-z0-9_$])"

STRING = re.compile(f"{_DQ}|{_SQ}|{_BQ}")
MACRO = re.compile(rf"<<(?:{_DQ}|{_BQ}|{_INNER_APOSTROPHE}|{_SQ}|\[\[[\s\S]*?\]\]|(?!>>)[^\"'`])*+>>")
TAG = re.compile(rf"</?[A-Za-z](?:[^>\"']|{_DQ}|{_SQ})*+>")
ENTITY = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]*|#\d+|#[xX][0-9a-fA-F]+);")
VARIABLE = re.compile(_VARIABLE)
START = re.compile(r"<!--|<<|</?[A-Za-z]|\[\[|&|/\*|\$\{|[$_]")
SCRIPT_END = re.compile(r"<<\s*(?:/\s*script|endscript)\s*>>", re.I)
SCRIPT_STEP = re.compile(r'"(?:[^"\\]|\\[\s\S])*+(?:"|\\?\Z)|\'(?:[^\'\\]|\\[\s\S])*+(?:\'|\\?\Z)|`(?:[^`\\]|\\[\s\S])*+(?:`|\\?\Z)|//[^\n]*\n?|/\*[\s\S]*?(?:\*/|\Z)|<<')
HOLE_STEP = re.compile(f"{_DQ}|{_SQ}|{_BQ}|[{{}}\"'`]")


@dataclass
class Token:
    kind: str  # text comment macro code link html variable escape
    start: int
    end: int
    text: str
    name: str | None = None
    closing: bool = False
    fallback: bool = False
    body: tuple[int, int] = (0, 0)
    closed: bool = True


def in_identifier(ch: str) -> bool:
    return bool(ch) and (ch.isalnum() or ch in "_$")


def macro_name(raw: str) -> str:
    return re.split(r"[\s(\[{]", raw[2:-2].strip(), maxsplit=1)[0].lower()


def _script_end(text: str, at: int) -> tuple[int, int] | None:
    while m := SCRIPT_STEP.search(text, at):
        if m[0] == "<<":
            end = SCRIPT_END.match(text, m.start(), m.start() + 24)
            if end:
                return end.span()
            at = m.start() + 1
        else:
            at = m.end()
    return None


def _hole_end(text: str, at: int) -> int:
    depth, at = 1, at + 2
    while m := HOLE_STEP.search(text, at):
        at = m.end()
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return at
        elif len(m[0]) == 1:
            return -1
    return -1


def _token_at(text: str, at: int, lead: str) -> Token | None:
    """The token that starts here, or None if this is text after all."""

    def until(mark: str, skip: int) -> int:
        found = text.find(mark, at + skip)
        return len(text) if found < 0 else found + len(mark)

    def made(kind: str, end: int, **more) -> Token:
        return Token(kind, at, end, text[at:end], **more)

    if lead == "<!--":
        return made("comment", until("-->", 4))
    if lead == "/*":
        return made("comment", until("*/", 2))
    if lead == "[[":
        return made("link", until("]]", 2))
    if lead == "<<":
        m = MACRO.match(text, at)
        end = m.end() if m else text.find(">>", at + 2) + 2
        if end < at + 2:
            return None
        name, closing = macro_name(text[at:end]), re.match(r"<<\s*/", text[at:end]) is not None
        if name == "script" and not closing:
            close = _script_end(text, end)
            return made("code", close[1] if close else len(text), name=name, body=(end, close[0] if close else len(text)), closed=close is not None)
        return made("macro", end, name=name, closing=closing, fallback=m is None, body=(at + 2, end - 2))
    if lead == "&":
        m = ENTITY.match(text, at, at + 32)
        return made("html", m.end()) if m else None
    if lead == "${":
        end = _hole_end(text, at)
        if end > 0:
            return made("variable", end)
    elif lead[0] == "<":
        m = TAG.match(text, at)
        return made("html", m.end()) if m else None
    if lead[0] in "$_" and lead != "${" and not in_identifier(text[at - 1 : at]):
        m = VARIABLE.match(text, at)
        return made("variable", m.end()) if m else None
    return None


def tokenize(text: str) -> list[Token]:
    out: list[Token] = []
    shown = at = 0
    while m := START.search(text, at):
        token = _token_at(text, m.start(), m[0])
        if token is None:
            at = m.start() + 1
            continue
        if token.start > shown:
            out.append(Token("text", shown, token.start, text[shown : token.start]))
        out.append(token)
        at = shown = token.end
    if shown < len(text):
        out.append(Token("text", shown, len(text), text[shown:]))
    return out


def depths(tokens: list[Token]) -> list[int]:
    """Nesting before each token.  Only end... names lower it: a closing with a slash has a name of its own, as in the original."""
    out, now = [], 0
    for t in tokens:
        out.append(now)
        if t.kind == "macro":
            if t.name in ("if", "for", "switch"):
                now += 1
            elif t.name in ("endif", "endfor", "endswitch"):
                now = max(0, now - 1)
    return out


def decode_entities(text: str) -> str:
    """Six names and numeric references, in one pass; anything else stays."""

    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] == "#":
            code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
            return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]
        return ENTITIES.get(body.lower(), m[0])

    return re.sub(r"&(#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", one, text)


def split_link(inner: str) -> tuple[str, str] | None:
    """(label, target) of the inside of a link, or None where one string is both."""
    if "|" in inner:
        label, target = inner.split("|", 1)
    elif "->" in inner:
        label, target = inner.split("->", 1)
    elif "<-" in inner:
        target, label = inner.split("<-", 1)
    elif "][" in inner:
        label, target = inner.split("][", 1)
    else:
        return None
    return label, target


@dataclass
class Label:
    start: int
    end: int
    text: str
    quote: str | None = None


def link_label(token: Token) -> Label | None:
    parts = split_link(token.text[2:-2])
    if parts is None or parts[0] == token.text[2:-2]:
        return None
    return Label(token.start + 2, token.start + 2 + len(parts[0]), parts[0])


def macro_label(token: Token) -> Label | None:
    if token.name not in LABEL_MACROS:
        return None
    m = re.match(r"(\s*[^\s(]+\s*)(?:\"([^\"]*)\"|'([^']*)')", token.text[2:-2])
    if not m:
        return None
    k = 2 if m[2] is not None else 3
    return Label(token.start + 2 + m.start(k), token.start + 2 + m.end(k), m[k], "\"'"[k - 2])


def inner_link_labels(text: str, start: int, end: int) -> list[Label]:
    """Labels of links with a target of their own inside a macro's body."""
    out = []
    for m in re.compile(r"\[\[([\s\S]*?)\]\]").finditer(text, start):
        if m.end() > end:
            break
        parts = split_link(m[1])
        if parts is None or re.search(r"\],\s*\[", m[1]):
            continue
        label, at = parts[0], m.start() + 2
        quoted = STRING.fullmatch(label)
        if quoted:
            out.append(Label(at + 1, at + len(label) - 1, label[1:-1], label[0]))
        else:
            out.append(Label(at, at + len(label), label))
    return out


def link_targets(text: str) -> list[str]:
    out = []
    for m in re.finditer(r"\[\[([\s\S]*?)\]\]", text):
        if not re.search(r"\],\s*\[", m[1]):
            parts = split_link(m[1])
            out.append(fold(parts[1] if parts else m[1]))
    return out


def fold(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


# What reads as text.
_URL = re.compile(r"(?:https?://|//)[^\s]+", re.I)
_HOST = re.compile(r"(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:[a-z]{2,})(?:[/?#][^\s]*)?", re.I)


def has_word(text: str) -> bool:
    return re.search(r"[A-Za-z]{2,}", text) is not None


def is_url(text: str) -> bool:
    s = text.strip()
    return bool(s) and not re.search(r"\s", s) and bool(_URL.fullmatch(s) or _HOST.fullmatch(s))


def is_name(text: str) -> bool:
    """A structural string rather than a label: blank, or one word with identifier signs."""
    s = text.strip()
    return not s or not re.search(r"\s", s) and re.search(r"[$_.\[\]{}()]", s) is not None


def is_label_text(text: str) -> bool:
    return not is_url(text) and not is_name(text) and has_word(text)


def reads_as_prose(text: str) -> bool:
    s = text.strip()
    if not re.search(r"[A-Za-z]{2}", s):
        return False
    words = [w for w in s.split() if re.search(r"[A-Za-z]", w)]
    alone = not re.search(r"\s", s)
    if alone and (re.search(r"[/\\]", s) or re.fullmatch(r"[A-Za-z_$][\w$]*(\.[\w$]+)+", s, re.A)):
        return False
    if s[0] == "<" and ">" not in s:
        return False
    plain = all(re.fullmatch(r"[a-z0-9][a-z0-9_-]*", w) for w in words)
    if plain and (len(words) >= 3 or any("-" in w or "_" in w for w in words)):
        return False
    return len(words) >= 2 or re.search(r"[.!?…][\"')\]]*$", s) is not None


def reads_as_argument(text: str) -> bool:
    """The stricter test for a bare string argument: a finished sentence, three words, or a capital first."""
    s = text.strip()
    return reads_as_prose(s) and bool(re.search(r"[.!?…][\"')\]]*$", s) or len(s.split()) >= 3 or re.match(r"[0-9£$]?[A-Z]", s))


@dataclass
class Literal:
    key: str | None
    outer: tuple[int, int]
    inner: tuple[int, int]
    text: str
    quote: str
    markup: bool = field(default=False)


_LEX = re.compile(rf"(?P<line>//[^\n]*\n?)|(?P<block>/\*[\s\S]*?(?:\*/|\Z))|(?P<apostrophe>{_INNER_APOSTROPHE})|(?P<string>{_DQ}|{_SQ}|{_BQ})|(?P<word>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<space>\s+)|(?P<op>===|!==|==|!=|<=|>=|=>|&&|\|\||\?\.|[\s\S])")


def display_literals(text: str, start: int, end: int) -> list[Literal]:
    """String literals of a stretch of code that read as prose and are neither keys, nor decided on, nor names of a call."""
    out: list[Literal] = []
    last, what, at = "op", "(start)", start
    while at < end:
        m = _LEX.match(text, at)
        kind, piece, stop = m.lastgroup, m[0], m.end()
        if kind in ("line", "block"):
            last, what, at = "op", ";", min(stop, end)
        elif kind == "apostrophe":
            last, what, at = "op", "'", stop
        elif kind == "string":
            if stop > end:
                last, what, at = "op", "?", at + 1
                continue
            after = re.compile(r"\s*").match(text, stop, end).end()
            if text[after : after + 1] == ":" and last == "op" and what in ("{", ",", "(", ";", "(start)"):
                last, what, at = "key", piece[1:-1], stop
                continue
            barred = last in ("word", "op") and what in DECIDING_WORDS or last == "call" and what in NAMING_CALLS
            if not barred and reads_as_prose(piece[1:-1]):
                out.append(Literal(what.lower() if last == "key" else None, (at, stop), (at + 1, stop - 1), piece[1:-1], piece[0], re.search(r"<<|<[A-Za-z/]", piece[1:-1]) is not None))
            last, what, at = "value", "", stop
        elif kind == "word":
            stop = min(stop, end)
            after = re.compile(r"\s*").match(text, stop, end).end()
            last, what, at = ("call" if text[after : after + 1] == "(" else "word"), text[at:stop].lower(), stop
        elif kind == "space":
            at = stop
        elif piece in "\"'`" and len(piece) == 1:
            last, what, at = "op", "?", stop
        else:
            if piece == ":" and last in ("word", "key"):
                last = "key"
            else:
                last, what = "op", piece
            at = stop
    return out


def literal_tokens(raw: str) -> list[Token]:
    """Tokens of a literal's inside: scanned without its escapes, mapped back, with escapes in plain text as tokens of their own."""
    if "\\" not in raw:
        return tokenize(raw)
    spans = [m.span() for m in re.finditer(r"\\[\s\S]|[\s\S]", raw)]
    bare = "".join(raw[b - 1] for _, b in spans)
    out: list[Token] = []
    for t in tokenize(bare):
        a, b = spans[t.start][0], spans[t.end - 1][1]
        if t.kind != "text":
            out.append(replace(t, start=a, end=b, text=raw[a:b]))
            continue
        for m in re.finditer(r"\\[\s\S]|(?:[^\\]|\\\Z)+", raw[a:b]):
            out.append(Token("escape" if m[0][0] == "\\" and len(m[0]) == 2 else "text", a + m.start(), a + m.end(), m[0]))
    return out


def protect(tokens: list[Token]) -> tuple[str, list[dict]]:
    """The text with every other token as a numbered placeholder, and the placeholders."""
    parts, marks = [], []
    for t in tokens:
        if t.kind == "text":
            parts.append(t.text)
        else:
            marks.append({"placeholder": f"{OPEN}{len(marks)}{SHUT}", "raw": t.text, "kind": t.kind, "name": t.name})
            parts.append(marks[-1]["placeholder"])
    return "".join(parts), marks


def restore(protected: str, marks: list[dict]) -> str:
    for m in marks:
        protected = protected.replace(m["placeholder"], m["raw"])
    return protected


def payload(protected: str, marks: list[dict]) -> str:
    for m in marks:
        protected = protected.replace(m["placeholder"], " ")
    return protected


def joins_up(text: str, tokens: list[Token]) -> bool:
    ends = [0, *(t.end for t in tokens)]
    return all(t.start == e and text[t.start : t.end] == t.text for t, e in zip(tokens, ends)) and ends[-1] == len(text)


# Strings that the code looks up.  Fixed values: the forms in which keys stand.
_Q = r"(\"[^\"\n]*\"|'[^'\n]*')"
_KEY_VALUE = re.compile(rf"(?<![A-Za-z0-9_$])[\"']?([A-Za-z_][A-Za-z0-9_]*)[\"']?\s*:\s*(\"[^\"\n]*\"|'[^'\n]*'|\[[^\]\n]*\])")
_LOOKUPS = [
    re.compile(rf"\.(?:{'|'.join(KEY_CALLS)})\s*\(\s*{_Q}", re.I),
    re.compile(rf"\bcase\s+{_Q}", re.A),
    re.compile(rf"<<\s*(?:{'|'.join(NAMED_BY)})\s+{_Q}", re.I),
    re.compile(rf"(?:^|[\s(!,])(?:is|isnot|eq|neq|==|===|!=|!==)\s*{_Q}"),
]


def lookup_keys(name: str, text: str) -> set[str]:
    """Lower-cased strings of 2 to 160 characters that a passage's name, links and code use as keys."""
    found = [name or "", *link_targets(text)]
    for m in _KEY_VALUE.finditer(text):
        if m[1].lower() in DATA_KEYS:
            items = [x.strip() for x in m[2][1:-1].split(",")] if m[2][0] == "[" else [m[2]]
            found += [x[1:-1] for x in items if x[:1] in ("'", '"') and x]
    for pattern in _LOOKUPS:
        found += [m[1][1:-1] for m in pattern.finditer(text)]
    return {x.strip().lower() for x in found if 2 <= len(x.strip()) <= 160}
