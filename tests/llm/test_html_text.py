import html
import re

import pytest

from textloom.llm.html_text import extract_html, main_text, smoothed, threshold
from textloom.llm.queries import op8_html_text

CASES = {
    "nothing": (None, ""),
    "empty": ("", ""),
    "plain": ("just text", "just text"),
    "article": ("<title>t</title><nav><a href=1>Home</a></nav><article><h1>A &amp; B</h1><p>one<br>two<p>three <b>x</b>\n y</article><footer>f</footer>", "A & B\none two\nthree x y"),
    "in articles": ("<article><header><h1>T</h1><p>by X</p></header><p>a</p><aside>s</aside><div class='ad-box'>z</div><form>f</form><section id=comments><p>c</p></section><footer>g</footer></article>", "T\na"),
    "comment article": ("<article><p>a</p><article class='comment-body'><p>c</p></article></article>", "a"),
    "main": ("<body><header>h</header><main><p>a</p><p>b</p></main><div class=cookie-notice>c</div>", "a\nb"),
    "script text": ("<script>var a='<p>no</p>'</script><article>x<style>p{}</style><p>y<script>z</script></article>", "x\ny"),
    "unclosed ad": ("<article><p>a<div class=ad><p>b</div><p>c", "a\nc"),
    "lists": ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one\ntwo\nx\ny"),
    "references": ("<article>&lt;p&gt; &#65;&#x42; &nbsp;&am &amp &quo</article>", "<p> AB &am & &quo"),
    "hyphenated names": ("<article><div class='social-impact'><p>body one</p></div><section id='related-work'><h2>Work</h2><p>body two</p></section><div class='side-bar'>x</div><div class=cookieNotice>y</div><div id=menu-2>z</div></article>", "body one\nWork\nbody two"),
    "cards after": ("<article><h1>T</h1><p>The article itself.</p></article><article class='related-card'><h3><a href=1>Other</a></h3><p>Teaser</p></article>", "T\nThe article itself."),
    "heading alone": (f"<article><h1>T</h1></article><div class=text><p>{'The body stands outside. ' * 9}</p><p>short</p></div><div><p><a href=1>more</a></p></div>", f"T\n{('The body stands outside. ' * 9).strip()}\nshort"),
    "label and math": ("<article><p>Press <label>this key</label> if <math><mi>x</mi></math> is 0.</p></article>", "Press this key if x is 0."),
    "short lines": (f"<article>{'<p>Few words here.</p>' * 20}</article><div>{'A long legal remark that nobody reads. ' * 5}</div>", "\n".join(["Few words here."] * 20)),
    "teasers": (f"<article><a href=1>One</a></article><article><a href=2>Two</a></article><div><p>{'Text of the page. ' * 20}</p></div>", ("Text of the page. " * 20).strip()),
    "divs": (f"<div><div><p>{'First words. ' * 20}</p></div><div><p>tiny</p></div><div><p>{'Last words. ' * 20}</p></div></div><div><ul><li><a href=1>a</a></ul></div>", f"{('First words. ' * 20).strip()}\ntiny\n{('Last words. ' * 20).strip()}"),
    "has-sidebar": ("<div class='page has-sidebar'><article>a</article></div>", "a"),
}


@pytest.mark.parametrize("name", CASES)
def test_small_pages(name):
    page, text = CASES[name]
    assert main_text(page) == text


def test_regions_without_an_article():
    long = "A sentence that goes on for a while so that its ratio of text to tags is high, as in an article. " * 3
    links = "".join(f"<li><a href='{i}'>l{i}</a></li>" for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><h2>Head</h2><p>{long}</p><p>short</p><p>{long}</p></div><div><ul>{links}</ul></div></body>"
    assert main_text(page) == f"Head\n{long.strip()}\nshort\n{long.strip()}"


def test_smoothing_and_threshold():
    assert smoothed([3.0] * 5) == pytest.approx([3.0] * 5)
    assert 2 < threshold([1, 2, 1.5, 90, 100]) < 90


def test_very_long_page():
    page = "<article>" + "<p>word &amp; word</p>" * 60_000 + "</article>"
    assert main_text(page) == "\n".join(["word & word"] * 60_000)


def expected(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return "\n".join(x for b in re.split(r"</?(?:p|h1)>", inner) if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split())))


def test_query_over_the_whole_table(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op8_html_text(spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, expected(pages[r.page_id].html), len(r.text))


def test_edge_rows(spark):
    df = spark.createDataFrame([(None, None, "x"), (2, "", "y"), (2, "<p>a", "z")], "page_id long, html string, text string")
    assert sorted(tuple(r) for r in extract_html(df).select("text", "main_text").collect()) == [("x", ""), ("y", ""), ("z", "a")]
    assert extract_html(df.limit(0)).count() == 0


def test_without_word_list_the_clusters_still_decide(spark, sf_dir, monkeypatch):
    """With no word for adverts and notices known and elements not told apart by name, regions are chosen by their text alone."""
    import textloom.llm.html_text as ht

    monkeypatch.setattr(ht, "SKIP_WORDS", set())
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    exact = dropped = whole = 0
    for r in pages:
        exact += ht.main_text(r.html) == expected(r.html)
        loose = re.sub("<(/?)article>", r"<\1div>", r.html)
        parser = ht.Lines()
        parser.feed(loose)
        parser.close()
        kept = set(ht.main_text(loose).split("\n"))
        dropped += any(" ".join("".join(x.text).split()) not in kept for x in parser.lines if "".join(x.text).strip())
        body = expected(r.html).split("\n")
        whole += sum(len(x) for x in body if x in kept) >= 0.9 * sum(map(len, body))
    print(f"{len(pages)} pages: {exact} exact by clusters, {dropped} lose lines without article elements, {whole} then keep nine tenths of the article")
    assert exact >= 0.95 * len(pages) and dropped >= 0.5 * len(pages) and whole >= 0.95 * len(pages)


def test_a_column_named_like_the_result_is_replaced(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "old", "x")], "page_id long, html string, main_text string, text string")
    assert extract_html(df).select("main_text", "text").collect() == [("a", "x")]
