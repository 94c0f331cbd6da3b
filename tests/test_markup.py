import pytest
from hypothesis import given, settings
from hypothesis import strategies as s

from textloom.functions import markup as mk
from textloom.functions import scan

PIECES = ["<<if $a>>", "<</if>>", "<<else>>", "<<he>>", "[[Go|Hall]]", "[[x", "]]", "<b>", "</b>", "<!--", "-->", "/*", "*/", "${", "}", "$x.y", "_z", "foo_bar", "&amp;", "&", "'", '"', "`", "\\", "<<script>>", "<</script>>", " word ", "漢", "<<link \"Hi\">>", "\n"]


@settings(max_examples=300, deadline=None)
@given(s.lists(s.sampled_from(PIECES), max_size=20).map("".join))
def test_tokens_cover_any_text_once(text):
    tokens = mk.tokenize(text)
    assert mk.joins_up(text, tokens) and "".join(t.text for t in tokens) == text
    inner = mk.literal_tokens(text)
    assert "".join(t.text for t in inner) == text
    protected, marks = mk.protect(tokens)
    assert mk.restore(protected, marks) == text
    found = scan.scan_passage(text, set())
    assert all(text[u["start_offset"] : u["end_offset"]] == u["raw_text"] for u in found.units)
    assert all(mk.restore(u["protected_text"], u["placeholders"]) == u["raw_text"] for u in found.units)


def kinds(text):
    return [(t.kind, t.text) for t in mk.tokenize(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("see <<he>> go", [("text", "see "), ("macro", "<<he>>"), ("text", " go")]),
        ('<<set $x to "a >> b">>!', [("macro", '<<set $x to "a >> b">>'), ("text", "!")]),
        ("<<say you're here>> x", [("macro", "<<say you're here>>"), ("text", " x")]),
        ("<<link [[Greet <<him>>|Hall]]>>", [("macro", "<<link [[Greet <<him>>|Hall]]>>")]),
        ('<<bad "open>> rest', [("macro", '<<bad "open>>'), ("text", " rest")]),
        ("full_name 漢_name _own $a.b[0]", [("text", "full_name 漢_name "), ("variable", "_own"), ("text", " "), ("variable", "$a.b[0]")]),
        ("<a href='x>y'>t</a>", [("html", "<a href='x>y'>"), ("text", "t"), ("html", "</a>")]),
        ("1 < 2 & 3", [("text", "1 < 2 & 3")]),
        ("${a ? '}' : {b}} end", [("variable", "${a ? '}' : {b}}"), ("text", " end")]),
        ('<<script>>s="<</script>>"; // <</script>>\n/* <</script>> */<</script>>after', [("code", '<<script>>s="<</script>>"; // <</script>>\n/* <</script>> */<</script>>'), ("text", "after")]),
        ("a<!-- x", [("text", "a"), ("comment", "<!-- x")]),
        ("[[open", [("link", "[[open")]),
    ],
)
def test_tokens(text, want):
    assert kinds(text) == want


def test_depth_falls_at_end_names_alone():
    tokens = mk.tokenize("<<if $a>>x<</if>>y<<endif>>z<<endif>>")
    assert [d for t, d in zip(tokens, mk.depths(tokens)) if t.kind == "text"] == [1, 1, 0]


def test_macro_names_stop_at_arguments():
    assert [mk.macro_name(x) for x in ("<<print[`a`][0]>>", "<<If $a>>", "<</if>>", "<<= $x>>")] == ["print", "if", "/if", "="]


def test_entities_decode_once():
    assert mk.decode_entities("&amp;lt; &LT; &#65;&#x42; &quot;&apos; &unknown; &") == "&lt; < AB \"' &unknown; &"


@pytest.mark.parametrize("link, label", [("[[Go home|Hall]]", "Go home"), ("[[Go->Hall]]", "Go"), ("[[Hall<-Go]]", "Go"), ("[[Go][Hall]]", "Go"), ("[[Hall]]", None)])
def test_link_labels(link, label):
    found = mk.link_label(mk.tokenize(link)[0])
    assert (found.text if found else None) == label


def test_label_and_prose_predicates():
    assert mk.is_url("example.org/wiki/A_B") and mk.is_url("//host/x") and not mk.is_url("Help") and not mk.is_url("go to example.org")
    assert mk.is_name("$x") and mk.is_name("_a.b") and mk.is_name(" ") and not mk.is_name("Two words.")
    assert mk.is_label_text("No") and not mk.is_label_text("x")
    assert mk.reads_as_prose("Locked.") and mk.reads_as_prose("Red coat") and not mk.reads_as_prose("light z-hidden") and not mk.reads_as_prose("a/b") and not mk.reads_as_prose("one two three")
    assert mk.reads_as_argument("Dark blue") and not mk.reads_as_argument("dark Blue") and mk.reads_as_argument("She is, well, late.")


def units(text, known=()):
    return [(u["kind"], u["raw_text"], u["risk_level"], u["context"]) for u in scan.scan_passage(text, set(known)).units]


def test_runs_break_at_blocks_and_links():
    assert units("One <b>bold</b> $x<p>Two<<set $y to 1>>Three [[Go on|Hall]] x1") == [
        ("passage_text", "One <b>bold</b> $x", "L1", None), ("passage_text", "Two", "L0", None), ("passage_text", "Three ", "L0", None), ("link_label", "Go on", "L1", "link")]


def test_code_strings_follow_the_export_rules():
    assert units('<<set $a to {sentence: "They wait here.", id: "no such"}>>') == [("passage_text", "They wait here.", "L0", "js-double")]
    assert units("<<print 'They wait.'>>") == [("passage_text", "They wait.", "L0", "js-single")]
    assert units('<<run log("Something is wrong here.")>>', ["something is wrong here."]) == []
    assert units('<<if $a is "Some text here.">>') == []
    assert units('<<link "Open door" "Hall">><</link>>')[0] == ("macro_label", "Open door", "L1", "arg-double")
    found = scan.scan_passage('<<set $a to "dark-blue coat-rack">> <<foo "a b>>', set())
    assert [i["code"] for i in found.issues] == []


def test_residue_and_unclosed_code_are_issues():
    codes = lambda t: [i["code"] for i in scan.scan_passage(t, set()).issues]
    assert codes("Left >> over") == ["passage-text-unparsed"]
    assert codes("<<script>>never closed") == ["code-block-unterminated"]
    assert codes('<<set $x to "open>> text') == ["macro-scan-fallback"]


def test_lookup_keys():
    keys = mk.lookup_keys("The Hall", "[[Go|Cellar]] {id: 'key one', tags: ['a1', \"b2\"], name: 'Shown'} x.includes(\"Deep\") <<goto 'Far Room'>> $a is 'Red' <<case \"Blue\">>")
    assert keys == {"the hall", "cellar", "key one", "a1", "b2", "deep", "far room", "red", "blue"}
