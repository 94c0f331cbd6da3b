import pytest

from textloom.functions import columns as tc
from textloom.functions import structure as st

F0, F1 = "⟦0⟧", "⟦1⟧"


def test_strict_placeholders():
    assert st.strict_placeholders(f"a {F0} {F1}", f"{F0} b {F1}") == []
    assert [c for c, _ in st.strict_placeholders(f"{F0}{F1}", f"{F1}{F0}")] == ["PLACEHOLDER_ORDER_CHANGED"]
    assert [c for c, _ in st.strict_placeholders(f"{F0}{F1}", F0)][0] == "PLACEHOLDER_COUNT_CHANGED"


def test_soft_macros_may_go_but_context_macros_not():
    marks = [{"placeholder": F0, "raw": "<<he>>", "kind": "macro", "name": "he"}, {"placeholder": F1, "raw": "<<person1>>", "kind": "macro", "name": "person1"}]
    ok = st.verify("<<he>> and <<person1>>", "und <<person1>>", None, f"{F0} and {F1}", f"und {F1}", marks)
    assert ok == []
    bad = st.codes(st.verify("<<he>> and <<person1>>", "<<he>> und", None, f"{F0} and {F1}", f"{F0} und", marks))
    assert "PLACEHOLDER_MISMATCH" in bad and "V3_PRONOUN_MACRO_REMOVED" in bad


def test_variable_next_to_a_letter_of_any_script():
    marks = [{"placeholder": F0, "raw": "_wall.name", "kind": "variable", "name": None}]
    assert st.verify("The _wall.name is", "墙_wall.name的", None, f"The {F0} is", f"墙{F0}的", marks) == []
    assert "V3_VARIABLE_CHANGED" in st.codes(st.verify("text", "text with $new"))


@pytest.mark.parametrize(
    "a, b, code",
    [
        ("<<if $a>>x<</if>>", "<<if $b>>x<</if>>", "COND_EXPR_CHANGED"),
        ("<<if $a>>x<<else>>y<</if>>", "<<if $a>>x<</if>>", "COND_BRANCH_COUNT_CHANGED"),
        ("<<if $a>>x<</if>>", "<<if $a>>x", "MACRO_BALANCE_CHANGED"),
        ("<<if $a>><<if $b>>x<</if>><</if>>", "<<if $a>><</if>><<if $b>>x<</if>>", "COND_NESTING_CHANGED"),
        ("<<if $a>><<he>><<else>>y<</if>>", "<<if $a>>x<<else>><<he>><</if>>", "PRONOUN_MACRO_MOVED_ACROSS_BRANCH"),
        ("<<foo>>", "<<bar>>", "MACRO_NAME_CHANGED"),
        ("[[Go|Hall]]", "[[Go|Cellar]]", "LINK_TARGET_CHANGED"),
        ("a <b>x</b>", "a x", "HTML_NESTING_CHANGED"),
        ("a ${b}", "a ${c}", "TEMPLATE_EXPR_CHANGED"),
    ],
)
def test_structure_codes(a, b, code):
    assert code in st.codes(st.compare(a, b))
    assert st.compare(a, a) == [] and st.compare(b, b) == []


def test_plain_tokens_may_move_between_branches():
    assert st.compare("<<if $a>>$x one<<else>>two<</if>>", "<<if $a>>eins<<else>>zwei $x<</if>>") == []


def test_substitutes_and_helpers():
    assert st.compare("<<his>> x", "<<h_his>> x", substitutes={"his": "h_his"}, helper_prefix="h_") == []
    assert "MACRO_SUBSTITUTION_MISMATCH" in st.codes(st.compare("x", "<<h_his>> x", helper_prefix="h_"))
    assert st.compare("<<foo>>", "<<bar>>", allow={"MACRO_NAME_CHANGED"}) == []


@pytest.mark.parametrize(
    "context, a, b, code",
    [(None, "a", "a ` b", "TEXT_BACKTICK_UNBALANCED"), (None, "a", "`a`", None), ("arg-double", "a", 'a "b"', "MACRO_ARG_DELIMITER_INSERTED"), ("arg-single", "a", "it's", "MACRO_ARG_DELIMITER_INSERTED"), ("arg-single", "a", "a >> b", "MACRO_ARG_DELIMITER_INSERTED"), ("link", "a", "a|b", "LINK_LABEL_DELIMITER_INSERTED"), ("link", "a", "“b”", None), ("js-double", "a", 'say "b"', None)],
)
def test_context_findings_in_both_forms(spark, context, a, b, code):
    assert next((c for c, _ in st.context_findings(context, a, b)), None) == code
    row = spark.createDataFrame([(context, a, b)], "c string, a string, b string")
    assert row.select(tc.context_code(row.c, row.a, row.b).alias("x")).first().x == code


def test_escapes_in_both_forms(spark):
    text = 'a "b" \'c\' `d` ${e} \\ \n\r'
    rows = spark.createDataFrame([(c, text) for c in ("js-double", "js-single", "js-template", "link", None)], "c string, t string")
    for r in rows.select("c", tc.escape_for(rows.c, rows.t).alias("x")).collect():
        assert r.x == st.escape_for(r.c, text)
    assert st.escape_for("js-double", '"${x}"\n') == '\\"\\${x}\\"\\n'


def test_tiers():
    found = {c: t for t, c, _ in st.tiers("<<if $a gt 1>><b id=x title=y>%s</b><<money 5>><<he>><</if>>", "<<if $a gt 2>><i>%d</i><<money 6>><<foo>>")}
    assert found["HARD_CONDITION_CHANGED"] == "hard" and found["HARD_PRINTF_CHANGED"] == "hard" and found["HARD_CONTROL_MACRO_ARG_CHANGED"] == "hard" and found["HARD_HTML_ATTR_CHANGED"] == "hard"
    assert found["STRUCT_HTML_CHANGED"] == found["STRUCT_MACRO_NAME_CHANGED"] == "structural" and found["SOFT_PRONOUN_MACRO_CHANGED"] == "soft" and found["MANUAL_HTML_ATTR_REVIEW"] == "manual"
    assert st.tiers("same <<he>>", "same <<he>>") == []


def test_arguments_and_holes():
    assert [st.argument_count(x) for x in ("", "a", "a, b", 'f(a, b), "c, d"')] == [0, 1, 2, 2]
    assert st.holes("${ a + 'b' } \\${c}") == ["${a+''}"]


def test_column_helpers(spark):
    df = spark.createDataFrame([("aXbXc", "X", "-"), ("aaa", "aa", "b"), ("none", "q", "z"), ("x", "", "y")], "c string, n string, b string")
    rows = df.select(tc.occurrences(df.c, df.n).alias("k"), tc.replace_first(df.c, df.n, df.b).alias("r")).collect()
    assert [(r.k, r.r) for r in rows] == [(2, "a-bXc"), (1, "ba"), (0, "none"), (0, "x")]
    one = spark.createDataFrame([(["a", "a", "b"], ["a", "c"])], "a array<string>, b array<string>")
    assert [tuple(x) for x in one.select(tc.bag_delta(one.a, one.b).alias("d")).first().d] == [("a", -1), ("b", -1), ("c", 1)]
    ident = spark.createDataFrame([("<<he>> [[1|Hall]] <b></b>&amp;",), ("<<he>> text",), (None,)], "t string")
    assert [r.x for r in ident.select(tc.is_identity(ident.t).alias("x")).collect()][:2] == [True, False]
