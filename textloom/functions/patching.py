"""Plan of literal replacements for one passage, proven by replaying it.

The consumer replaces the first occurrence of an entry's text (or all, if it says so), entry after entry.  A plan is right if that
gives the passage with every entry's sites exchanged.  ``Sheet`` holds the passage as patched so far and takes an entry only if
the replacement hits its own sites.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

GROWTH, CLUSTER_GROWTH, ROUNDS = 200, 4000, 200


@dataclass
class Site:
    """A unit that can be placed: its span and what goes there."""

    unit: str
    start: int
    end: int
    text: str
    to: str


@dataclass
class Entry:
    unit: str
    frm: str
    to: str
    span: tuple[int, int]
    patch: tuple[int, int]
    covers: list[tuple[int, int]]
    units: list[str]
    edits: list[tuple[int, int, str]]
    raw: str
    all: bool = False
    grown: tuple[int, int] | None = None
    cluster: bool = False


@dataclass
class Plan:
    entries: list[Entry] = field(default_factory=list)
    skipped: list[tuple[str, str, str]] = field(default_factory=list)  # unit, reason, detail
    covered: dict[str, tuple[str, str]] = field(default_factory=dict)  # unit -> entry, how
    stats: dict[str, int] = field(default_factory=dict)


def places(text: str, piece: str) -> list[int]:
    """Occurrences that don't overlap, from the left."""
    out, at = [], text.find(piece) if piece else -1
    while at >= 0:
        out.append(at)
        at = text.find(piece, at + len(piece))
    return out


def every_place(text: str, piece: str) -> list[int]:
    """Occurrences, overlapping ones too."""
    out, at = [], text.find(piece)
    while at >= 0:
        out.append(at)
        at = text.find(piece, at + 1)
    return out


def exchange(text: str, edits: list[tuple[int, int, str]], start: int = 0, end: int | None = None, strict: bool = False) -> str | None:
    """The slice with its edits made; an edit that overlaps one before it is left out, or spoils all if ``strict``."""
    parts, at = [], start
    for a, b, to in sorted(edits, key=lambda e: e[0]):
        if a < at:
            if strict:
                return None
            continue
        parts += [text[at:a], to]
        at = b
    return "".join([*parts, text[at : len(text) if end is None else end]])


def replay(text: str, entries: list[Entry]) -> str:
    for e in entries:
        text = text.replace(e.frm, e.to) if e.all else text.replace(e.frm, e.to, 1)
    return text


class Sheet:
    def __init__(self, text: str):
        self.text, self.patched = text, text
        self.taken: list[tuple[int, int, int]] = []  # start, end, change of length

    def free(self, start: int, end: int) -> bool:
        k = bisect_left(self.taken, (start,))
        before = k > 0 and self.taken[k - 1][1] > start
        return not before and not (k < len(self.taken) and self.taken[k][0] < end)

    def moved(self, at: int) -> int:
        return at + sum(d for s, _, d in self.taken[: bisect_left(self.taken, (at,))])

    def take(self, e: Entry) -> bool:
        if not all(self.free(a, b) for a, b in e.covers):
            return False
        hits = places(self.patched, e.frm) if e.all else [self.patched.find(e.frm)]
        after = self.patched.replace(e.frm, e.to) if e.all else self.patched.replace(e.frm, e.to, 1)
        own = [self.moved(a) for a, _ in e.covers]
        if hits != own and after != self._spliced(own, e):
            return False
        self.patched = after
        for a, b in e.covers:
            insort(self.taken, (a, b, len(e.to) - (b - a)))
        return True

    def _spliced(self, own: list[int], e: Entry) -> str:
        return exchange(self.patched, [(a, a + y - x, e.to) for a, (x, y) in zip(own, e.covers)])


def _matches(text: str, start: int, end: int, q: int, most: int) -> tuple[int, int]:
    """How far the surroundings of q agree with those of [start, end), to the left and to the right."""
    left = right = 0
    size = end - start
    while left < min(start, q, most) and text[start - left - 1] == text[q - left - 1]:
        left += 1
    while right < most and end + right < len(text) and q + size + right < len(text) and text[end + right] == text[q + size + right]:
        right += 1
    return left, right


def anchor(sheet: Sheet, start: int, end: int, growth: int = GROWTH) -> tuple[int, int] | None:
    """The least growth (then least to the left) that makes the span unique and touches nothing taken."""
    text = sheet.text
    rivals = [(q, *_matches(text, start, end, q, growth)) for q in every_place(text, text[start:end]) if q != start]
    for total in range(min(growth, start + len(text) - end) + 1):
        for left in range(max(0, total - (len(text) - end)), min(total, start) + 1):
            right = total - left
            if not sheet.free(start - left, end + right):
                continue
            same = [q for q, a, b in rivals if left <= a and right <= b]
            size = end - start + total
            if any(abs(q - start) >= size for q in same):
                continue
            piece = text[start - left : end + right]
            if not same or text.find(piece) == start - left and text.count(piece) == 1:
                return left, right
    return None


def least_unique(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The least growth that makes the span unique, whatever it crosses."""
    rivals = [q for q in places(text, text[start:end]) if q != start]
    if not rivals:
        return 0, 0
    agree = [(q, *_matches(text, start, end, q, len(text))) for q in rivals]
    best = None
    for left in sorted({0, *(a + 1 for _, a, _ in agree), *(q + 1 for q in rivals)}):
        if left > min(start, CLUSTER_GROWTH):
            break
        right = max([0, *(b + 1 for q, a, b in agree if q >= left and left <= a)])
        if right <= min(len(text) - end, CLUSTER_GROWTH) and (best is None or left + right < sum(best)):
            best = (left, right)
    if best is None:
        return None
    piece = text[start - best[0] : end + best[1]]
    return best if text.count(piece) == 1 and text.find(piece) == start - best[0] else None


def _cluster(text: str, seed: Site, entries: list[Entry], loose: list[Site], whole: bool) -> Entry | str:
    """One entry for a run of sites that can't be placed alone, with all entries and sites that it crosses; or why not."""
    sites, inside = {seed.unit: seed}, {}
    start, end = seed.start, seed.end
    for _ in range(ROUNDS):
        spans = [(s.start, s.end) for s in sites.values()] + [c for e in inside.values() for c in e.covers]
        start, end = min([start, *(a for a, _ in spans)]), max([end, *(b for _, b in spans)])
        grown = least_unique(text, start, end)
        if grown is None:
            return "cluster-not-unique"
        a, b = start - grown[0], end + grown[1]
        if not whole and (a, b) == (0, len(text)):
            return "cluster-whole-passage"
        more = {e.unit: e for e in entries if e.unit not in inside and any(x < b and a < y for x, y in e.covers)}
        inside |= more
        held = {u for e in inside.values() for u in e.units}
        extra = {s.unit: s for s in loose if s.unit not in sites and s.unit not in held and s.start < b and a < s.end}
        sites |= extra
        if more or extra:
            continue
        edits = [(s.start, s.end, s.to) for s in sites.values()] + [x for e in inside.values() for x in e.edits]
        made = exchange(text, edits, a, b, strict=True)
        if made is None:
            return "cluster-edit-overlap"
        units = list(dict.fromkeys([*sites, *(u for e in inside.values() for u in e.units)]))
        return Entry(seed.unit, text[a:b], made, (start, end), (a, b), [(a, b)], units, edits, text[start:end], grown=grown, cluster=True)
    return "cluster-loop"


def _whole_passage(text: str, entries: list[Entry], loose: list[Site]) -> Entry | None:
    """The passage as one entry: what is left for sites of a text that repeats itself, as no lesser piece of it is unique."""
    edits = [x for e in entries for x in e.edits] + [(s.start, s.end, s.to) for s in loose]
    made = exchange(text, edits, strict=True)
    if made is None or made == text:
        return None
    units = list(dict.fromkeys([*(u for e in entries for u in e.units), *(s.unit for s in loose)]))
    whole = (0, len(text))
    return Entry(loose[0].unit, text, made, whole, whole, [whole], units, edits, text, grown=(0, 0), cluster=True)


def _proven(text: str, entries: list[Entry]) -> bool:
    return replay(text, entries) == exchange(text, [(*c, e.to) for e in entries for c in e.covers])


def plan_passage(text: str, units: list[dict], growth: int = GROWTH, clusters: bool = True, whole: bool = False) -> Plan:
    """units: unit_id, start_offset, end_offset, raw_text, to (the translation with its placeholders filled in).

    ``whole`` lets a cluster grow to the whole passage, which also holds the sites that no cluster can make unique.
    """
    plan = Plan(stats=dict.fromkeys(("uniform_all", "anchored", "conflict_multi_site", "conflict_patch", "span_mismatch", "overlap", "cluster", "clustered_units", "cluster_failed"), 0))
    sites: list[Site] = []
    last = None
    for u in sorted(units, key=lambda u: (u["start_offset"] is None, u["start_offset"] or 0)):
        a, b = u["start_offset"], u["end_offset"]
        if a is None or b is None or a < 0 or b <= a or b > len(text):
            plan.skipped.append((u["unit_id"], "span-mismatch", f"outside {a}..{b}"))
        elif text[a:b] != u["raw_text"]:
            plan.skipped.append((u["unit_id"], "span-mismatch", "text-differs"))
        else:
            site = Site(u["unit_id"], a, b, u["raw_text"], u["to"] or "")
            if last and site.start < last.end:
                plan.skipped.append((site.unit, "overlap", f"{a}..{b} meets {last.start}..{last.end}"))
                plan.stats["overlap"] += 1
            else:
                sites.append(site)
            last = site
            continue
        plan.stats["span_mismatch"] += 1
    groups: dict[str, list[Site]] = {}
    for s in sites:
        groups.setdefault(s.text, []).append(s)
    head: dict[str, str] = {}
    found = {piece: places(text, piece) for piece in groups}
    for piece, group in groups.items():
        if len(group) > 1 and len({s.to for s in group}) == 1 and found[piece] == [s.start for s in group]:
            head |= {s.unit: group[0].unit for s in group}
    sheet, loose = Sheet(text), []
    taken: set[str] = set()

    def place(e: Entry, how: str) -> bool:
        if not sheet.take(e):
            return False
        plan.entries.append(e)
        plan.covered[e.unit] = (e.unit, how)
        taken.add(e.unit)
        return True

    for s in sites:
        own, n = (s.start, s.end), len(found[s.text])
        if head.get(s.unit, s.unit) != s.unit:
            continue
        if s.unit in head:
            group = groups[s.text]
            covers = [(x.start, x.end) for x in group]
            if place(Entry(s.unit, s.text, s.to, own, own, covers, [x.unit for x in group], [(a, b, s.to) for a, b in covers], s.text, all=True), "uniform-all"):
                plan.stats["uniform_all"] += 1
            else:
                loose.append((s, "patch-conflict", "group-meets-entry"))
            continue
        if n == 1 and place(Entry(s.unit, s.text, s.to, own, own, [own], [s.unit], [(*own, s.to)], s.text), "simple"):
            continue
        grown = anchor(sheet, s.start, s.end, growth)
        if grown is None:
            detail = f"no-anchor {n}" if n > 1 else "span-taken"
            loose.append((s, "patch-conflict-multi-site" if n > 1 else "patch-conflict", detail))
            continue
        a, b = s.start - grown[0], s.end + grown[1]
        e = Entry(s.unit, text[a:b], text[a : s.start] + s.to + text[s.end : b], own, (a, b), [(a, b)], [s.unit], [(*own, s.to)], s.text, grown=grown)
        if place(e, "anchored"):
            plan.stats["anchored"] += 1
        else:
            loose.append((s, "patch-conflict", "anchor-meets-entry"))
    for s in sites:
        first = head.get(s.unit, s.unit)
        if first == s.unit:
            continue
        if first in taken:
            plan.skipped.append((s.unit, "duplicate-passage-from", first))
            plan.covered[s.unit] = (first, "duplicate-superseded")
        else:
            loose.append((s, "patch-conflict", f"group-lost {first}"))
    proven, why = list(plan.entries), {}
    if clusters:
        solved: set[str] = set()
        trial = list(plan.entries)
        for s, _, _ in sorted(loose, key=lambda x: x[0].start):
            if s.unit in solved:
                continue
            made = _cluster(text, s, trial, [x[0] for x in loose], whole)
            if isinstance(made, str):
                why[s.unit] = made
                plan.stats["cluster_failed"] += 1
                continue
            trial = [e for e in trial if not any(x < made.patch[1] and made.patch[0] < y for x, y in e.covers)] + [made]
            solved |= set(made.units)
        if whole and loose and (any(x[0].unit not in solved for x in loose) or not _proven(text, trial)):
            made = _whole_passage(text, plan.entries, [x[0] for x in loose])
            if made is not None:
                trial, solved, why, plan.stats["cluster_failed"] = [made], set(made.units), {}, 0
        if _proven(text, trial):
            proven = trial
        else:
            solved, plan.stats["cluster_failed"], why = set(), len(loose), {}
        loose = [x for x in loose if x[0].unit not in solved]
    else:
        plan.stats["cluster_failed"] = len(loose)
    for s, reason, detail in loose:
        plan.skipped.append((s.unit, reason, detail + (f"; cluster: {why[s.unit]}" if s.unit in why else "")))
        plan.stats["conflict_multi_site" if reason == "patch-conflict-multi-site" else "conflict_patch"] += 1
    for e in proven:
        if e.cluster:
            plan.stats["cluster"] += 1
            plan.stats["clustered_units"] += len(e.units)
            plan.covered |= {u: (e.unit, "cluster") for u in e.units}
    plan.entries = sorted(proven, key=lambda e: e.patch)
    return plan


def failures(text: str | None, entries: list[Entry]) -> list[tuple[str, str]]:
    """(code, unit) of what is wrong with a passage's entries; units of a passage-wide failure are blank."""
    if text is None:
        return [("PASSAGE_MISSING", e.unit) for e in entries]
    out = []
    for e in entries:
        n = len(places(text, e.frm))
        checks = (("FROM_MISSING", e.frm not in text), ("NO_OP", e.frm == e.to), ("SPAN_MISMATCH", text[e.span[0] : e.span[1]] != e.raw), ("ALL_FLAG_MISSING", n > 1 and not e.all), ("FROM_MISSING", n < 1))
        out += [(code, e.unit) for code, bad in checks if bad]
    spans = sorted(((e.span, e.unit) for e in entries), key=lambda x: x[0][0])
    out += [("OVERLAP", b[1]) for a, b in zip(spans, spans[1:]) if b[0][0] < a[0][1]]
    if not _proven(text, entries):
        out.append(("PATCH_REPLAY_MISMATCH", ""))
    return out
