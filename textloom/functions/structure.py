"""Checks of a source text against its translation: placeholders, enclosing context, branch structure, tiers."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import zip_longest

from textloom.functions import markup as mk

# Fixed values of the checks.
SOFT_MACROS = set(
    "print = - he hes he's him his himself hers her she shes they them their theirs "
    "person person1 person2 person3 persons personsimple personselect someone someones "
    "girl boy woman women man men lady ladies guy guys lad lass lassie "
    "sir maam ma mum mummy dad father mother grandpa grandma uncle auntie aunt "
    "master mistress lord wife husband spouse sister brother theowner neutral "
    "npc_he npc_his npc_him nnpc_he nnpc_his nnpc_him phe phim pher pshe "
    "steed_he steed_his steed_him that there it its "
    "bhe bhes bhis bhim bhimself childhe childshe childhim childhis babyis person4 pcpetname petname".split()
)
CONTEXT_MACROS = set("personselect person1 person2 person3 someone someones their hisselect person persons".split())
VALUE_MACROS = set("link linkappend linkprepend linkreplace button cycle listbox option textbox checkbox radiobutton note tooltip".split()) | set("set unset capture remember forget".split())
PAIRED = "for while switch widget macro script link button replace append prepend nobr silently timed repeat type addinlineevent css audio if".split()
BLOCKS = {k: "open" for k in PAIRED} | {f"end{k}": "close" for k in PAIRED} | dict.fromkeys(["elseif", "else", "case", "default"], "branch")
BRANCH_OPEN, BRANCH_NEXT = {"if", "switch", "unless"}, {"elseif", "else", "case", "default"}
CONDITIONS = {"if", "elseif", "unless", "while", "for"}
CONTEXT_QUOTE = {"js-double": '"', "js-single": "'", "js-template": "`", "arg-double": '"', "arg-single": "'"}

_MACRO = re.compile(r"<<\s*(/?)([A-Za-z_][A-Za-z0-9_-]*|=-?|-)([\s\S]*?)>>")
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9-]*)((?:\s+[^<>]*?)?)/?>")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][A-Za-z0-9_:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>=`]+))")
_KEPT_ATTRIBUTE = re.compile(r"(?:id|class|src|href|name|for|action|method)|data[-:].*", re.I | re.S)
_VARIABLE = re.compile(rf"(?<![\w$]){mk._VARIABLE}")
_PLACEHOLDER = re.compile(f"{mk.OPEN}\\d+{mk.SHUT}", re.A)


@dataclass
class Macro:
    name: str
    closing: bool
    body: str

    @property
    def full(self) -> str:
        return "/" + self.name if self.closing else self.name


def macros(text: str) -> list[Macro]:
    return [Macro("print" if m[2] in ("=", "-", "=-") else m[2].lower(), bool(m[1]), m[3]) for m in _MACRO.finditer(text)]


def macro_names(text: str | None) -> list[str]:
    out = []
    for m in re.finditer(r"<<\s*([^>]*?)>>", text or ""):
        body = m[1].strip()
        name = re.split(r"[\s(]", body, maxsplit=1)[0].lower()
        out.append(re.sub(r"^-+", "-", name) or "-")
    return out


def placeholders_in(text: str | None) -> list[str]:
    return _PLACEHOLDER.findall(text or "")


def unquoted(text: str) -> str:
    return re.sub(r"'[^']*'", "''", re.sub(r'"[^"]*"', '""', text))


def variables(text: str) -> list[str]:
    return [re.sub(r"\s+", "", v) for v in _VARIABLE.findall(text)]


def holes(text: str) -> list[str]:
    """Template holes that aren't escaped, without quoted text and white space."""
    out, at = [], 0
    while (at := text.find("${", at)) >= 0:
        slashes = len(text[:at]) - len(text[:at].rstrip("\\"))
        end = text.find("}", at + 2)
        if slashes % 2 or end < 0:
            at += 1
            continue
        out.append(re.sub(r"\s+", "", unquoted(text[at : end + 1])))
        at = end + 1
    return out


def tags(text: str) -> list[str]:
    return [("close" if m[0][1] == "/" else "self" if m[0].endswith("/>") else "open") + ":" + m[1].lower() for m in _TAG.finditer(text)]


def attributes(text: str) -> tuple[list[str], list[str]]:
    """Attributes whose value must stay, as name=value, and the names of the others."""
    kept, other = [], []
    for m in _ATTRIBUTE.finditer(text):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        if _KEPT_ATTRIBUTE.fullmatch(m[1]):
            kept.append(f"{m[1].lower()}={mk.fold(value)}")
        else:
            other.append(m[1].lower())
    return kept, other


def delta(a, b) -> tuple[list[str], list[str]]:
    """(added, removed) of two bags as 'key xN', in the order of first sight."""
    x, y = Counter(a), Counter(b)
    keys = list(dict.fromkeys([*x, *y]))
    return [f"{k} x{y[k] - x[k]}" for k in keys if y[k] > x[k]], [f"{k} x{x[k] - y[k]}" for k in keys if x[k] > y[k]]


def strict_placeholders(source: str | None, target: str | None) -> list[tuple[str, str]]:
    """Count, bag and order of placeholders must be the same."""
    a, b = placeholders_in(source), placeholders_in(target)
    x, y = Counter(a), Counter(b)
    out = [("PLACEHOLDER_COUNT_CHANGED", f"{len(a)}->{len(b)}")] if len(a) != len(b) else []
    out += [("PLACEHOLDER_MISMATCH", f"{k} {x[k]}->{y[k]}") for k in dict.fromkeys([*a, *b]) if x[k] != y[k]]
    return out + ([("PLACEHOLDER_ORDER_CHANGED", f"{','.join(a)}->{','.join(b)}")] if a != b else [])


def omissions(source: str, target: str) -> list[str]:
    """Soft macros, other than those that write context, that the target has fewer of."""
    x, y = Counter(macro_names(source)), Counter(macro_names(target))
    return [k for k in x if k in SOFT_MACROS and k not in CONTEXT_MACROS and y[k] < x[k]]


def relaxed_placeholders(source: str, target: str, marks: list[dict], omitted: list[str]) -> list[tuple[str, str]]:
    """As strict, but placeholders of omitted macros may go."""
    names = {}
    for m in marks:
        if m["placeholder"] not in names:
            names[m["placeholder"]] = (m.get("name") or "").lower() or next(iter(macro_names(m["raw"])), "")
    a, b = placeholders_in(source), placeholders_in(target)
    free = [p for p in a if names.get(p) and names[p] in omitted]
    bound = [p for p in a if not (names.get(p) and names[p] in omitted)]
    need, have = Counter(bound), Counter(b)
    out = [("PLACEHOLDER_MISMATCH", f"{k} {v}->{have[k]}") for k, v in need.items() if have[k] != v]
    out += [("PLACEHOLDER_DUPLICATED", p) for p in free if have[p] > 1]
    if [p for p in b if p in need] != bound:
        out.append(("PLACEHOLDER_ORDER_CHANGED", "required placeholder order differs"))
    return out + [("PLACEHOLDER_ADDED", p) for p in b if p not in a]


def context_findings(context: str | None, source: str | None, target: str | None) -> list[tuple[str, str]]:
    """Delimiters of the enclosing syntax that the target has more of than the source."""
    a, b = source or "", target or ""
    if context is None:
        return [("TEXT_BACKTICK_UNBALANCED", 'translation introduces an unpaired "`" into passage markup')] if b.count("`") % 2 else []
    if context in ("arg-double", "arg-single"):
        quote = CONTEXT_QUOTE[context]
        if b.count(quote) > a.count(quote):
            return [("MACRO_ARG_DELIMITER_INSERTED", f"translation introduces {json.dumps(quote)} inside a {quote}-quoted macro argument; use full-width quotes instead")]
        if b.count(">>") > a.count(">>"):
            return [("MACRO_ARG_DELIMITER_INSERTED", 'translation introduces ">>" inside a macro argument')]
    if context == "link":
        for sign in ("|", "]]", "->", "<-", "][", "`"):
            if b.count(sign) > a.count(sign):
                return [("LINK_LABEL_DELIMITER_INSERTED", f"translation introduces {json.dumps(sign)} inside a link label")]
    return []


def escape_for(context: str | None, text: str | None) -> str:
    """What a script string of this context needs escaped; other contexts have no escapes."""
    text = text or ""
    if context not in ("js-double", "js-single", "js-template"):
        return text
    quote = CONTEXT_QUOTE[context]
    out = text.replace("\\", "\\\\").replace(quote, "\\" + quote).replace("${", "\\${")
    return out if quote == "`" else out.replace("\n", "\\n").replace("\r", "\\r")


@dataclass
class Branch:
    path: str
    kind: str
    cond: str = ""
    parent: int | None = None
    depth: int = 0
    tokens: list[str] = field(default_factory=list)


@dataclass
class Tree:
    branches: list[Branch]
    open: int


def _outside_macros(text: str) -> list[str]:
    return re.sub(r"<<[\s\S]*?>>", " \x01 ", text).split("\x01")


def parse(text: str) -> Tree:
    """Branches in order with their tokens; tokens outside macros go to the branch that is open at the end."""
    root = Branch("top", "root")
    branches, stack, opened = [root], [], 0  # stack: [conditional, branches so far, current branch]

    def here() -> list[str]:
        return (stack[-1][2] if stack else root).tokens

    for m in macros(text):
        if m.name in BRANCH_OPEN:
            if not m.closing:
                new = Branch(f"{opened}.0", "if", mk.fold(unquoted(m.body)), stack[-1][0] if stack else None, len(stack))
                branches.append(new)
                stack.append([opened, 0, new])
                opened += 1
                continue
            if stack:
                stack.pop()
                continue
        if m.name in BRANCH_NEXT and not m.closing and stack:
            top = stack[-1]
            top[1] += 1
            top[2] = Branch(f"{top[0]}.{top[1]}", m.name, "" if m.name in ("else", "default") else mk.fold(unquoted(m.body)), stack[-2][0] if len(stack) > 1 else None, len(stack) - 1)
            branches.append(top[2])
            continue
        here().append(f"pronoun:{m.name}" if m.name in SOFT_MACROS else f"macro:{m.full}")
        if not m.closing:
            here().extend([*variables(m.body), *holes(m.body), *(f"link:{x}" for x in mk.link_targets(m.body))])
    for part in _outside_macros(text):
        here().extend([*variables(part), *holes(part), *tags(part), *(f"link:{x}" for x in mk.link_targets(part))])
    return Tree(branches, len(stack))


def fingerprint(text: str) -> str:
    """Canonical JSON of balance, branches, sorted tokens and links."""
    tree = parse(text)
    links = sorted(x for part in _outside_macros(text) for x in mk.link_targets(part))
    whole = {
        "balance": {"depth": tree.open, "min": 0},
        "branches": [{"path": b.path, "kind": b.kind, "cond": b.cond} for b in tree.branches],
        "branchTokens": {b.path: sorted(b.tokens) for b in tree.branches},
        "links": links,
    }
    return json.dumps(whole, separators=(",", ":"), ensure_ascii=False)


def _code_of(key: str) -> str:
    for lead, code in (("link:", "LINK_TARGET_CHANGED"), ("${", "TEMPLATE_EXPR_CHANGED"), ("$", "VARIABLE_CHANGED"), ("_", "VARIABLE_CHANGED"), ("open:", "HTML_NESTING_CHANGED"), ("close:", "HTML_NESTING_CHANGED"), ("self:", "HTML_NESTING_CHANGED")):
        if key.startswith(lead):
            return code
    return "MACRO_NAME_CHANGED"


def compare(source: str, target: str, allow: set[str] = frozenset(), omitted: list[str] | None = None, substitutes: dict[str, str] | None = None, helper_prefix: str | None = None) -> list[tuple[str, str]]:
    """Findings about branches and their tokens.  substitutes: soft macro -> helper macro that may stand for it."""
    out: list[tuple[str, str]] = []
    a, b = parse(source), parse(target)
    if a.open != b.open:
        out.append(("MACRO_BALANCE_CHANGED", f"fromDepth={a.open} toDepth={b.open} fromMin=0 toMin=0"))
    if len(a.branches) != len(b.branches):
        kinds = lambda t: ",".join(x.kind for x in t.branches)
        out.append(("COND_BRANCH_COUNT_CHANGED", f"from={len(a.branches)} to={len(b.branches)} from=[{kinds(a)}] to=[{kinds(b)}]"))
    else:
        pairs = list(zip(a.branches, b.branches))
        for code, of, text in (
            ("COND_ORDER_CHANGED", lambda x: x.kind, lambda x: x.kind),
            ("COND_EXPR_CHANGED", lambda x: x.cond, lambda x: f"[{x.cond}]"),
            ("COND_NESTING_CHANGED", lambda x: (x.parent, x.depth), lambda x: f"[parent={'null' if x.parent is None else x.parent} depth={x.depth}]"),
        ):
            n = next((i for i, (x, y) in enumerate(pairs) if of(x) != of(y)), None)
            if n is not None:
                out.append((code, f"#{n} from={text(pairs[n][0])} to={text(pairs[n][1])}"))
        subs = {k.lower(): v.lower() for k, v in (substitutes or {}).items()}
        removed, added = [], []
        for x, y in pairs:
            plus, minus = delta(x.tokens, y.tokens)
            removed += [(x.path, k.split(" ")[0]) for k in minus]
            added += [(y.path, k.split(" ")[0]) for k in plus]
        for path, key in removed:
            if not key.startswith("pronoun:"):
                out.append((_code_of(key), f"{path} removed {key}"))
                continue
            form = key[8:]
            if form in subs:
                stand_in = f"macro:{subs[form]}"
                if (path, stand_in) in added:
                    added.remove((path, stand_in))
                    continue
                elsewhere = next((x for x in added if x[1] == stand_in), None)
                if elsewhere:
                    added.remove(elsewhere)
                    out.append(("MACRO_SUBSTITUTION_MOVED_ACROSS_BRANCH", f"{form} -> {subs[form]} at {path}"))
                    continue
            if form in (omitted or []):
                continue
            moved = any(k == key and p != path for p, k in added)
            out.append(("PRONOUN_MACRO_MOVED_ACROSS_BRANCH" if moved else "PRONOUN_MACRO_REMOVED", f"{form} at {path}"))
        for path, key in added:
            if key.startswith("pronoun:"):
                continue
            if helper_prefix and key.startswith(f"macro:{helper_prefix}") and key[6:] not in subs.values():
                out.append(("MACRO_SUBSTITUTION_MISMATCH", f"{key[6:]} at {path} is not a declared substitution target"))
            elif _code_of(key) != "MACRO_NAME_CHANGED" or key.startswith("macro:"):
                out.append((_code_of(key), f"{path} added {key}"))
    seen = {c for c, _ in out}
    for code, of in (("LINK_TARGET_CHANGED", lambda t: [x for p in [*_outside_macros(t), *(m.body for m in macros(t))] for x in mk.link_targets(p)]), ("HTML_NESTING_CHANGED", lambda t: [x for p in _outside_macros(t) for x in tags(p)])):
        plus, minus = delta(of(source), of(target))
        if code not in seen and (plus or minus):
            out.append((code, f"added=[{', '.join(plus)}] removed=[{', '.join(minus)}]"))
    return [x for x in out if x[0] not in allow]


def domain(protected: str | None, marks: list[dict] | None) -> str:
    """The text with its placeholders filled in between signs that no identifier holds."""
    out = protected or ""
    for m in marks or []:
        if m.get("placeholder"):
            out = out.replace(m["placeholder"], f"\x02{m['raw']}\x02")
    return out


def verify(source: str, target: str | None, context: str | None = None, protected: str | None = None, target_protected: str | None = None, marks: list[dict] | None = None, allow: set[str] = frozenset()) -> list[tuple[str, str]]:
    """All findings about one entry; by placeholders where the record carries a protected translation and the unit has any."""
    to = target or ""
    gone = omissions(source, to)
    out: list[tuple[str, str]] = []
    by_marks = target_protected is not None and bool(marks)
    if by_marks:
        out += relaxed_placeholders(protected or "", target_protected, marks, gone)
        if mk.restore(target_protected, marks) != target:
            out.append(("REVERSIBLE_MISMATCH", "restore != toRaw"))
    if not to.strip():
        out.append(("EMPTY_TRANSLATION", ""))
    if source == target:
        out.append(("NO_OP", ""))
    out += context_findings(context, source, to)
    pair = (domain(protected, marks), domain(target_protected, marks)) if by_marks else (source, to)
    return out + [(f"V3_{c}", d) for c, d in compare(*pair, allow=allow, omitted=gone)]


def codes(findings: list[tuple[str, str]]) -> list[str]:
    return list(dict.fromkeys(c for c, _ in findings))


def tiers(source: str, target: str) -> list[tuple[str, str, str]]:
    """(tier, code, detail) of a pair: hard, structural, soft and manual findings."""
    a, b = macros(source), macros(target)
    bare_a, bare_b = (re.sub(r"<<[\s\S]*?>>", " ", t) for t in (source, target))
    has_tag = any(re.search(r"<[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>", t) for t in (bare_a, bare_b))
    kept_a, other_a = attributes(bare_a) if has_tag else ([], [])
    kept_b, other_b = attributes(bare_b) if has_tag else ([], [])
    out: list[tuple[str, str, str]] = []

    def bag(tier: str, code: str, x: list[str], y: list[str], most: int | None = None, sign: str = ", ") -> None:
        plus, minus = delta(x, y)
        if plus or minus:
            out.append((tier, code, f"added=[{sign.join(plus[:most])}] removed=[{sign.join(minus[:most])}]"))

    conditions = lambda ms: [f"{mk.fold(unquoted(m.body))} :: {mk.fold(m.body)}" for m in ms if not m.closing and m.name in CONDITIONS]

    def numbers(ms: list[Macro]) -> list[str]:
        found = [(m.name, re.sub(r"\s+", "", unquoted(m.body))) for m in ms if not m.closing and m.name not in SOFT_MACROS | VALUE_MACROS]
        return [f"{n}({x})" for n, x in found if re.fullmatch(r"[-\d.,:%+*/()=<>$_{}\[\]]+", x, re.A) and re.search(r"\d", x, re.A)]

    blocks = lambda ms: [f"{BLOCKS[m.name]}:{m.name}" for m in ms if m.name in BLOCKS and (not m.closing or BLOCKS[m.name] == "close")]

    def balance(seq: list[str]) -> int:
        return sum(x.startswith("open:") for x in seq) - sum(x.startswith("close:") for x in seq)

    bag("hard", "HARD_VARIABLE_CHANGED", variables(source), variables(target))
    bag("hard", "HARD_TEMPLATE_HOLE_CHANGED", holes(source), holes(target))
    printf = re.compile(r"%(?:\d+\$)?[sdif]", re.A)
    bag("hard", "HARD_PRINTF_CHANGED", printf.findall(source), printf.findall(target))
    bag("hard", "HARD_LINK_TARGET_CHANGED", mk.link_targets(source), mk.link_targets(target))
    bag("hard", "HARD_CONDITION_CHANGED", conditions(a), conditions(b), 3, " | ")
    bag("hard", "HARD_CONTROL_MACRO_ARG_CHANGED", numbers(a), numbers(b))
    bag("hard", "HARD_HTML_ATTR_CHANGED", kept_a, kept_b, 3)
    seq_a, seq_b = blocks(a), blocks(b)
    if seq_a != seq_b:
        out.append(("structural", "STRUCT_BLOCK_SEQUENCE_CHANGED", f"fromDepth={balance(seq_a)} toDepth={balance(seq_b)} from=[{','.join(seq_a[:8])}] to=[{','.join(seq_b[:8])}]"))
    tags_a, tags_b = (tags(bare_a), tags(bare_b)) if has_tag else ([], [])
    if tags_a != tags_b:
        out.append(("structural", "STRUCT_HTML_CHANGED", f"from=[{','.join(tags_a[:8])}] to=[{','.join(tags_b[:8])}]"))
    bag("structural", "STRUCT_MACRO_NAME_CHANGED", [m.full for m in a if m.name not in SOFT_MACROS], [m.full for m in b if m.name not in SOFT_MACROS], 6)
    bag("soft", "SOFT_PRONOUN_MACRO_CHANGED", [m.full for m in a if m.name in SOFT_MACROS], [m.full for m in b if m.name in SOFT_MACROS], 6)
    bag("manual", "MANUAL_HTML_ATTR_REVIEW", other_a, other_b)
    return out


def argument_count(body: str | None) -> int:
    """Top-level commas plus one; 0 for a blank body."""
    text = (body or "").strip()
    if not text:
        return 0
    depth, quote, n = 0, "", 1
    for before, c in zip_longest(" " + text[:-1], text):
        if quote:
            quote = "" if c == quote and before != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and not depth:
            n += 1
    return n


def argument_counts(text: str, name: str) -> list[int]:
    return sorted(argument_count(m.body) for m in macros(text) if not m.closing and m.name == name)
