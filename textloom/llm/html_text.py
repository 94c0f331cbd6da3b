"""Main text of web pages: parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page's events.  Block elements start lines; a line has its text, the
characters of it inside links, the tags met in it, and the element that holds it.  What is no article text by its
element (menus, asides, forms, scripts ...) or by the words of its class, id or role (adverts, notices, reader comments
...) never becomes a line.  Then regions are selected:

* a line's ratio is its characters outside of links by the tags in it and one; ratios are smoothed with a Gaussian along the lines of one region,
  an outermost ``article``, else a ``main``, else the element that holds the lines' blocks;
* the threshold that separates the means of two clusters of the page's smoothed ratios best says which lines are high; regions with a high line that
  isn't mostly links are candidates, as is the region with the most text;
* where candidates in ``article`` or ``main`` hold at least half of the candidates' text, only these stay, so elements are a signal that the
  text has to confirm; else all candidates stay;
* a region that stays is taken whole, with a heading right before it and with regions between two that stay, unless these are mostly links.

Character references are decoded, white space inside a line becomes one space, lines are trimmed, empty ones left out, and
the rest is joined by one newline in page order.

Defined results: a null or empty page has an empty text; unclosed and stray tags end at the next element that closes what is
around them; text of any length is read whole; rows stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Element names of the HTML standard, words that sites use in class, id and role for what is no article, and words for mere layout.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIP = set("head title nav menu aside footer form script style noscript template iframe object canvas svg select option button textarea input dialog audio video map".split())
SKIP_WORDS = set("nav navbar navigation menu menus sidebar aside header masthead topbar footer ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall share sharing social breadcrumb breadcrumbs pagination pager comment comments commentlist disqus respond replies related recommended toolbar widget login search searchform copyright complementary contentinfo".split())
LAYOUT_WORDS = set("area bar block body box button buttons card cards container content count form footer group head icons inner item items left link links list main menu message outer page panel posts primary right row secondary section site slot strip text thread title top bottom unit widget wrap wrapper".split())
ARTICLE_WORDS = set("article post entry story content".split())
HEADING = {f"h{i}" for i in range(1, 7)}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select", "optgroup"}}
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
SIGMA = 1.0
KEEP, DROP, TITLES = 0, 1, 2


def _parts(name: str) -> list[str]:
    return [w.lower() for w in _SPLIT.split(name) if w]


def boilerplate(name: str) -> set[str]:
    """The words for no article in a class, id or role, if all of it is such words, layout words and numbers: ad-box, but not social-impact."""
    parts = _parts(name)
    whole = "".join(parts)
    if whole in SKIP_WORDS:
        return {whole}
    return set(parts) & SKIP_WORDS if all(w in SKIP_WORDS or w in LAYOUT_WORDS or w.isdigit() for w in parts) else set()


class Line:
    __slots__ = ("text", "linked", "tags", "holder", "region", "heading")

    def __init__(self, holder, region, heading):
        self.text, self.linked, self.tags = [], 0, 0
        self.holder, self.region, self.heading = holder, region, heading


class Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack = [("", KEEP, None)]  # element, what becomes of its text, its region
        self.ids, self.open_ids, self.line, self.open = 0, [0], None, Counter()

    def fate(self, tag: str, attrs: list, above: int, region) -> int:
        if above == DROP or tag in SKIP:
            return DROP
        names = [n for k, v in attrs if k in ("class", "id", "role") and v for n in v.split()]
        found = {w for n in names for w in boilerplate(n)}
        if tag in ("html", "body", "main"):
            found = set()
        elif tag == "article":
            found &= {"comment", "comments", "related", "recommended", "ad", "ads", "promo", "promoted", "sponsored"}
        if tag == "header" or found == {"header"}:
            return TITLES if region is not None or any(ARTICLE_WORDS & set(_parts(n)) for n in names) else DROP
        return DROP if found else above

    def start(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            if tag not in ("html", "head", "body"):
                self.pop_while({"p"}, BLOCK - {"p"})
            if tag in CLOSES:
                self.pop_while(CLOSES[tag], BARS[tag])
            self.line = None
        elif self.line is not None:
            self.line.tags += 1
            if tag in ("br", "hr"):
                self.line.text.append(" ")
        if tag in VOID:
            return
        _, above, region = self.stack[-1]
        self.ids += 1
        if tag == "article" and (region is None or region[0] != "article") or tag == "main" and region is None:
            region = (tag, self.ids)
        fate = self.fate(tag, attrs, above, region)
        self.stack.append((tag, fate, region))
        self.open_ids.append(self.ids)
        self.open[tag] += 1

    def pop_while(self, names: set, bars: set) -> None:
        """Close the nearest open element of these names, unless an element of bars is nearer."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in names:
                self.cut(k)
                return
            if self.stack[k][0] in bars:
                return

    def cut(self, k: int) -> None:
        self.open.subtract(x[0] for x in self.stack[k:])
        del self.stack[k:], self.open_ids[k:]

    def handle_starttag(self, tag, attrs):
        self.start(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.start(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.line = None
        elif self.line is not None:
            self.line.tags += 1
        if self.open[tag]:
            self.cut(next(k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k][0] == tag))

    def handle_data(self, data):
        _, fate, region = self.stack[-1]
        if fate == DROP or fate == TITLES and not any(self.open[h] for h in HEADING):
            return
        if self.line is None:
            if not data.strip():
                return
            k = next((k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k][0] in BLOCK), 0)
            holder = self.open_ids[max(0, k - 1)] if self.stack[k][0] in HEADING | {"p", "li", "pre", "blockquote"} else self.open_ids[k]
            self.line = Line(holder, region, self.stack[k][0] in HEADING)
            self.lines.append(self.line)
        self.line.text.append(data)
        if self.open["a"]:
            self.line.linked += len(data.strip())


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        a, b = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[a - i + reach : b - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[a:b])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """The split of the ordered values into two clusters with the greatest variance between them."""
    v = sorted(values)
    total, left, best, at = sum(v), 0.0, -1.0, v[0] if v else 0.0
    for i in range(1, len(v)):
        left += v[i - 1]
        if v[i] == v[i - 1]:
            continue
        gap = left / i - (total - left) / (len(v) - i)
        if (between := i * (len(v) - i) * gap * gap) > best:
            best, at = between, (v[i - 1] + v[i]) / 2
    return at


def select(lines: list[tuple[str, Line]]) -> list[str]:
    regions = [x.region or ("", x.holder) for _, x in lines]
    plain = [max(0, len(t) - x.linked) for t, x in lines]
    ratio: list[float] = []
    for _, run in groupby(range(len(lines)), key=lambda i: regions[i]):
        ratio += smoothed([plain[i] / (1 + lines[i][1].tags) for i in run])
    least = threshold(ratio)
    size: Counter = Counter()
    for r, n in zip(regions, plain):
        size[r] += n
    stay = {r for r, q, n, (t, _) in zip(regions, ratio, plain, lines) if q >= least and 2 * n > len(t)}
    if size:
        stay.add(max(size, key=lambda r: size[r]))
    marked = {r for r in stay if r[0]}
    if marked and 2 * sum(size[r] for r in marked) >= sum(size[r] for r in stay):
        stay = marked
    keep = [r in stay for r in regions]
    runs = [(k, list(run)) for k, run in groupby(range(len(lines)), key=lambda i: keep[i])]
    for n, (kept, run) in enumerate(runs):
        if kept:
            continue
        if 0 < n < len(runs) - 1 and not regions[runs[n - 1][1][-1]][0] and not regions[runs[n + 1][1][0]][0]:
            for r, own in groupby(run, key=lambda i: regions[i]):
                own = list(own)
                if not r[0] and 2 * sum(plain[i] for i in own) > sum(len(lines[i][0]) for i in own):
                    for i in own:
                        keep[i] = True
        if n < len(runs) - 1:
            for i in reversed(run):
                if not lines[i][1].heading:
                    break
                keep[i] = True
    return [t for k, (t, _) in zip(keep, lines) if k]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = [(" ".join("".join(x.text).split()), x) for x in parser.lines]
    return "\n".join(select([x for x in lines if x[0]]))


def extract_html(pages: DataFrame, html_col: str = "html", name: str = "main_text") -> DataFrame:
    """``pages`` with the main text as column ``name``; a column of that name is replaced, others pass as they are."""

    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(h) if isinstance(h, str) else "" for h in part], dtype=object)

    return pages.withColumn(name, extract(F.col(html_col)))
