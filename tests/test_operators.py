import pytest
from pyspark.sql import functions as F

from textloom.functions import columns as tc
from textloom.operators import coverage as cov
from textloom.operators import editor as ed
from textloom.operators import inventory as inv
from textloom.operators import kit
from textloom.operators import migration as mig
from textloom.operators import planner as pl
from textloom.operators import scenarios as sc
from textloom.streaming import imports

UNIT = f"unit_id string, passage string, raw_text string, protected_text string, placeholders {tc.MARKS_TYPE}, context string"


def story(spark, *passages):
    rows = [(n, n, name, [], text, 100 * n) for n, (name, text) in enumerate(passages)]
    return spark.createDataFrame(rows, "passage_ord int, pid int, name string, tags array<string>, content string, content_offset long")


def test_inventory_of_a_story(spark):
    scanned = inv.scan_passages(story(spark, ("Hall", "Hello <<he>>.<<set $x to {name: 'Red coat'}>> <<set $y to {note: 'Cellar door'}>>"), ("Cellar door", "[[Back|Hall]] >> text")))
    units = inv.units(scanned)
    rows = units.orderBy("passage_ord", "unit_ord").collect()
    assert [(r.unit_id, r.kind, r.raw_text) for r in rows] == [("0:0-13", "passage_text", "Hello <<he>>."), ("0:33-41", "passage_text", "Red coat"), ("1:2-6", "link_label", "Back")]
    assert rows[2].abs_start == 102 and rows[0].qa_status == "pending" and rows[0].widget is None
    found = {(r.code, r["count"]) for r in inv.issues(scanned, units).collect()}
    assert found == {("code-string-is-identifier", 1), ("passage-text-unparsed", 1)}
    assert {(r.facet, r.value): r.n for r in inv.histograms(units).collect()}["kind", "passage_text"] == 2


def test_a_claimed_span_is_an_issue(spark):
    twice = story(spark, ("A", "some text"), ("B", "some text")).withColumn("pid", F.lit(7))
    scanned = inv.scan_passages(twice)
    units = inv.units(scanned)
    assert units.where("claim = 1").count() == 1
    assert [(r.code, r.host) for r in inv.issues(scanned, units).collect()] == [("duplicate-unit-span", "7:0-9")]


def test_each_coverage_state(spark):
    units = spark.createDataFrame([(k, "P", t, t, [], None) for k, t in (("a", "one"), ("b", "two"), ("c", "three"), ("d", "four"), ("e", "<<he>>"), ("f", "six"))], UNIT)
    fp = units.select("unit_id", tc.source_fingerprint(units.protected_text).alias("fp")).collect()
    fps = {r.unit_id: r.fp for r in fp}
    records = spark.createDataFrame([("a", "P", "eins", None, fps["a"]), ("b", "P", "zwei", None, "stale"), ("c", "P", "drei <<x>>", None, fps["c"]), ("f", "P", "sechs", None, ""), ("z", "Q", "weg", None, "")], "unit_id string, passage string, translation string, protected_translation string, source_fingerprint string")
    states = cov.classify_coverage(units, records)
    got = {r.unit_id: r for r in states.collect()}
    assert {k: r.state for k, r in got.items()} == {"a": "translated-valid", "b": "superseded", "c": "rejected-structure", "d": "untranslated", "e": "translated-valid", "f": "translated-valid", "z": "obsolete"}
    assert got["e"].identity and got["c"].codes == ["V3_MACRO_NAME_CHANGED"]
    counts = {r.state: r.n for r in cov.coverage_counts(states).collect()}
    assert counts == {"translated-valid": 3, "untranslated": 1, "rejected-structure": 1, "superseded": 1, "unresolved": 0, "obsolete": 1}
    gate = cov.strict_gate(states).first()
    assert (gate.blocking_total, gate.strict_pass) == (3, False)
    marked = cov.mark_unresolved(states, spark.createDataFrame([("a",), ("e",), ("b",)], "unit_id string"))
    assert {r.unit_id: r.state for r in marked.collect() if r.unit_id in "abe"} == {"a": "unresolved", "b": "superseded", "e": "translated-valid"}


def test_import_ladder_and_repair(spark):
    units = spark.createDataFrame([(k, "P", "say <<he>> now", "say ⟦0⟧ now", [("⟦0⟧", "<<he>>", "macro", "he")], c) for k, c in (("a", None), ("b", None), ("c", None), ("d", "js-double"), ("e", None))], UNIT)
    entries = spark.createDataFrame(
        [("a", 0, "sag ⟦0⟧ jetzt", None, None, None, None), ("a", 1, "x", None, None, None, None), ("b", 0, " ", None, None, None, None), ("c", 0, "sag ⟦1⟧", None, None, None, None), ("d", 0, 'sag "⟦0⟧"', None, None, None, None), ("e", 0, "sag ⟦0⟧", "wrong", None, None, None), ("q", 0, "x", None, None, None, None)],
        "unit_id string, ord int, translation string, raw_source_hash string, protected_hash string, source_fingerprint string, structural_fingerprint string",
    )
    results = kit.classify_import(entries, units)
    got = {(r.unit_id, r.submitted): r for r in results.collect()}
    assert got["a", "sag ⟦0⟧ jetzt"].translation == "sag <<he>> jetzt" and got["a", "x"].reason == "duplicate-unit"
    assert got["b", " "].status == "deferred" and got["c", "sag ⟦1⟧"].reason == "qa-failed" and got["q", "x"].reason == "unit-not-in-target" and got["e", "sag ⟦0⟧"].reason == "source-hash-mismatch"
    assert got["d", 'sag "⟦0⟧"'].translation == 'sag \\"<<he>>\\"'
    conflicts = spark.createDataFrame([("a",)], "unit_id string")
    report = kit.import_report(results, conflicts, True).first()
    assert (report.accepted, report.rejected, report.deferred, report.conflicts, report.coverage_ok, report.ok) == (2, 4, 1, 1, True, False)
    fix, skipped = kit.repair_kit(kit.import_blockers(results, conflicts), units)
    assert {(r.unit_id, r.status, r.translation) for r in fix.collect()} == {("a", "rejected", "x"), ("a", "conflict", ""), ("b", "deferred", ""), ("c", "rejected", "sag ⟦1⟧"), ("e", "rejected", "sag ⟦0⟧")}
    assert [r.unit_id for r in skipped.collect()] == ["q"]
    assert kit.check_hand_off(kit.import_report(results, conflicts), "s", "t").first().reason == "target-story-mismatch"


def test_merge_of_both_files(spark):
    j = spark.createDataFrame([("a", "x", 0), ("a", " y ", 1), ("b", "", 2), ("c", "one", 3), ("d", None, 4)], "unit_id string, translation string, ord int")
    c = spark.createDataFrame([("a", "y", 0), ("b", "two", 1), ("c", "other", 2), ("", "lost", 3), ("e", " ", 4)], "unit_id string, translation string, ord int")
    assert {(r.unit_id, r.translation, r.source, r.conflict) for r in kit.merge_segments(j, c).collect()} == {("a", "y", "jsonl", False), ("b", "two", "csv", False), ("c", None, None, True), ("d", "", "none", False), ("e", "", "none", False)}


def test_chunks_have_no_gaps(spark):
    rows = spark.range(1000).withColumn("o", F.col("id") * 7 % 1000)
    got = sorted((r.row_index, r.o, r.chunk, r.filename) for r in kit.chunks(rows, 300, ("o",)).collect())
    assert [r[:2] for r in got] == [(n, n) for n in range(1000)] and got[-1][2:] == (3, "localization-kit-004.zip")


def test_migration_quirks(spark):
    units = spark.createDataFrame([("a", "P", "f1", "s", 1), ("n", "P", "f2", "s", 2), ("m", "P", "f2", "s", 3)], "unit_id string, passage string, source_fingerprint string, structural_fingerprint string, unit_ord int")
    records = spark.createDataFrame([("a", "P", "other", "s"), ("x", "P", "f2", "s"), ("y", "P", "f9", "s"), ("z", "Q", "f9", "s")], "unit_id string, passage string, source_fingerprint string, structural_fingerprint string")
    assert {(r.unit_id, r.outcome, r.new_unit_id) for r in mig.migrate_records(records, units).collect()} == {("a", "kept", "a"), ("x", "moved", "m"), ("y", "changed", None), ("z", "obsolete", None)}


def test_entry_validation(spark):
    passages = spark.createDataFrame([("P", "one two one <<he>>", 0), ("P", "later", 1)], "name string, content string, passage_ord int")
    kind = "ord int, id string, passage string, from_text string, to_text string, all_sites boolean, allow array<struct<code: string, reason: string>>"
    entries = spark.createDataFrame([(0, "i", "P", "one", "eins", None, None), (1, "i", "P", "two", "zwei", None, None), (2, None, "P", "two", "z", None, None), (3, None, "Q", "x", "y", None, None), (4, None, "P", "absent", "y", None, None), (5, None, "P", "one ", "<<foo>>", True, None), (6, None, "P", " <<he>>", " <<foo>>", None, [("STRUCT_MACRO_NAME_CHANGED", "ok"), ("x", "")]), (7, None, "", "a", "b", None, None)], kind)
    got = {r.ord: r for r in mig.validate_entries(entries, passages).collect()}
    assert got[0].errors == ["occurs-more-than-once"] and got[0].occurrences == 2 and got[0].first_pos == 0
    assert got[1].errors == ["duplicate-id"] and got[2].errors == ["duplicate-passage-from"] and got[3].errors == ["passage-not-found"] and got[4].errors == ["from-not-found"]
    assert got[5].errors == ["protection-STRUCT_MACRO_NAME_CHANGED"] and got[6].errors == ["allow-incomplete"] and got[7].errors == ["missing-passage"]


def test_alignment(spark):
    source = spark.createDataFrame([("A", "x\n"), ("B", "\n\n  y"), ("C", "  z"), ("D", "d"), ("StoryData", "{}"), ("F", "f")], "name string, raw string")
    target = spark.createDataFrame([("A", "x", 0), ("B", "  y", 1), ("C", "z", 2), ("D", "e", 3), ("E&amp;", "e", 4)], "name string, content string, ord int")
    assert {(r.name, r.relation) for r in mig.align_passages(source, target).collect()} == {("A", "exact"), ("B", "normalized"), ("C", "normalized"), ("D", "changed"), ("E&", "target-only"), ("F", "source-only"), ("StoryData", "metadata")}
    files = spark.createDataFrame([("a.js", "1"), ("b.js", "v build version"), ("c.js", "1 \n"), ("d.js", "1"), ("e.js", "1")], "path string, content string")
    built = spark.createDataFrame([("a.js", "/* h */\n1"), ("b.js", "v 2.0"), ("c.js", "1"), ("d.js", "2"), ("x\\y.js", "1"), (None, "q")], "file string, content string")
    assert {(r.path, r.relation) for r in mig.align_files(files, built, "2.0").collect()} == {("a.js", "exact"), ("b.js", "version-substituted"), ("c.js", "whitespace"), ("d.js", "changed"), ("e.js", "source-only"), ("x/y.js", "target-only")}
    fonts = spark.createDataFrame([("game/f/y.js",), ("game/z.ttf",)], "path string")
    assert {(r.basename, r.present) for r in mig.fonts_present(fonts, built).collect()} == {("y.js", True), ("z.ttf", False)}
    tree = spark.createDataFrame([("game/a.twee",), ("game/b.JS",), ("game/f.woff2",), ("x.twee",)], "path string")
    assert {(r.kind, r.n) for r in mig.files_by_kind(tree).collect()} == {("twee", 1), ("js", 1), ("fonts", 1), ("other", 1)}


def test_plan_over_passages(spark):
    passages = spark.createDataFrame([("P", "A bell. B bell."), ("Q", "one")], "name string, content string")
    units = spark.createDataFrame([("P", "1", 2, 6, "bell", [], "gong"), ("P", "2", 10, 14, "bell", [], "gong"), ("Q", "3", 0, 3, "one", [], "eins"), ("R", "4", 0, 1, "x", [], "y")], f"passage string, unit_id string, start_offset int, end_offset int, raw_text string, placeholders {tc.MARKS_TYPE}, translation string")
    rows = pl.build_plan(units, passages).collect()
    assert {(r.unit_id, r.from_text, r.all_sites) for r in rows if r.what == "entry"} == {("1", "bell", True), ("3", "one", False)}
    assert [(r.unit_id, r.reason) for r in rows if r.what == "skipped" and r.passage == "R"] == [("4", "passage-missing")]
    assert not [r for r in rows if r.what == "failure"]
    assert [(r.from_text, r.sites) for r in pl.uniform_groups(units, passages).collect()] == [("bell", 2)]


SEGMENT = "unit_id string, passage string, source string, translation string, status string, ord int"


def test_editor_checks(spark):
    seg = spark.createDataFrame([("a", "P", "Hi ⟦0⟧", "Hi", "unmarked", 0), ("b", "P", "Hello", "Hello", "unmarked", 1), ("c", "P", "plain", "odd <<print $x>>", "unmarked", 2), ("d", "P", "Hi ⟦0⟧", "", "unmarked", 3), ("e", "P", "50% {x} <not a tag>", "halb {x} <not a tag>", "", 4)], SEGMENT)
    got = {r.unit_id: [(i.severity, i.code) for i in r.x] for r in seg.select("unit_id", ed.segment_issues(seg.source, seg.translation).alias("x")).collect()}
    assert got == {"a": [("error", "PLACEHOLDER_COUNT_CHANGED")], "b": [("info", "SAME_AS_SOURCE")], "c": [("warn", "UNEXPECTED_STRUCTURE")], "d": [], "e": []}
    assert [r.x for r in seg.select(ed.has_blocking(ed.segment_issues(seg.source, seg.translation)).alias("x")).collect()] == [True, False, True, False, False]
    terms = spark.createDataFrame([("Robin", "R1"), ("Rob", "R2"), ("Red coat", "R3")], "source string, target string")
    said = spark.createDataFrame([("x", "You see Robin.", "no"), ("y", "You see Robin.", "R1"), ("z", "A Red coat", "no"), ("w", "robin Rob_", "no")], "unit_id string, source string, translation string")
    assert {(r.unit_id, r.term) for r in ed.terminology(said, terms).collect()} == {("x", "Robin"), ("z", "Red coat")}
    ignored = spark.createDataFrame([("x", "Robin")], "unit_id string, term string")
    assert {r.unit_id for r in ed.terminology(said, terms, ignored).collect()} == {"z"}


def test_editor_views_and_plans(spark):
    seg = spark.createDataFrame([("a", "Start", "Alpha", "1", "proofread", 0), ("b", "Room", "Beta", "", "flagged", 1), ("c", "Room", "Gamma", "3", "reviewed", 2)], SEGMENT)
    ids = lambda **k: [r.unit_id for r in ed.view(seg, **k).collect()]
    assert ids(kind="todo") == ["b"] and ids(kind="done") == ["a", "c"] and ids(query="room") == ["b", "c"] and ids(sort="todo") == ["b", "a", "c"] and ids(sort="passage") == ["b", "c", "a"] and ids(kind="term", term="Gamma") == ["c"] and ids(kind="flagged") == ["b"]
    assert ids(kind="issues", marked=spark.createDataFrame([("c",)], "unit_id string")) == ["c"]
    stats = ed.status_stats(seg).first()
    assert (stats.total, stats.translated, stats.percent, stats.flagged) == (3, 2, 67, 1)
    dup = spark.createDataFrame([("1", "P", "Same.", "x", "", 0), ("2", "P", "Same.", "", "", 1), ("3", "P", "Same.", "y", "", 2), ("4", "P", "Twin.", "z", "", 3), ("5", "P", "Twin.", " ", "", 4), ("6", "P", "  ", "q", "", 5), ("7", "P", "  ", "q", "", 6)], SEGMENT)
    assert {(r.source, r.n, r.divergent, r.empty_count) for r in ed.duplicate_groups(dup).collect()} == {("Same.", 3, True, 1), ("Twin.", 2, False, 1)}
    assert [(r.unit_id, r.after) for r in ed.duplicate_fill(dup).collect()] == [("5", "z")]
    choice = spark.createDataFrame([("Same.", "y")], "source string, chosen string")
    assert {(r.unit_id, r.after) for r in ed.duplicate_fill(dup, choice).collect()} == {("2", "y"), ("5", "z")}
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "9")], "unit_id string, translation string")
    assert {(r.unit_id, r.action) for r in ed.plan_handoff(seg, new).collect()} == {("a", "identical"), ("b", "change"), ("c", "conflict")}
    assert {r.unit_id for r in ed.plan_handoff(seg, new, "overwrite").where("action = 'change'").collect()} == {"b", "c"}
    pages = spark.createDataFrame([(1, 1), (5, 9), (6, 10), (50, 100), (99, 100)], "p int, t int")
    first, last = ed.page_window(pages.p, pages.t)
    assert [(r.a, r.b) for r in pages.select(first.alias("a"), last.alias("b")).collect()] == [(1, 1), (1, 9), (2, 10), (46, 54), (92, 100)]
    events = spark.createDataFrame([("a", 1, "new", False), ("a", 2, "gone", True)], "unit_id string, ord int, translation string, undone boolean")
    assert [(r.translation, r.status) for r in ed.apply_events(seg, events).where("unit_id = 'a'").collect()] == [("new", "unmarked")]
    stored = spark.createDataFrame([("a", "Alpha", "odd"), ("b", "Old", "flagged")], "unit_id string, source string, status string")
    assert [(r.unit_id, r.status) for r in ed.adopt_project(stored, seg).collect()] == [("a", "unmarked")]


def test_editor_migration(spark):
    old = spark.createDataFrame([("1", "Line one."), ("2", "Old two."), ("7", "Moved."), ("8", "Twice."), ("9", "Twice."), ("10", "Gone."), ("11", " ")], "unit_id string, source string")
    new = spark.createDataFrame([("1", "Line one."), ("2", "New two."), ("3", "Brand new."), ("7x", "Moved."), ("8x", "Twice."), ("8y", "Twice."), ("12", " ")], "unit_id string, source string")
    got = {(r.unit_id, r.outcome) for r in ed.plan_migration(old, new).collect()}
    assert {("1", "safe"), ("2", "modified"), ("3", "added"), ("7x", "suggestion"), ("8x", "ambiguous"), ("8y", "ambiguous"), ("10", "deleted"), ("12", "added")} <= got


SCENARIO = "id string, tier string, label string, passage string, overlay string, require array<string>, expect_target array<string>, forbid_source array<string>, blocked boolean, interaction struct<kind: string, input: string, value: string>, prelude array<string>"


def test_scenarios(spark):
    rows = spark.createDataFrame([("a", "A", "l", "P", None, ["#x"], ["t"], [], None, None, None), ("b", "B", "", None, None, [], None, None, None, ("search", "i", None), ["bad"]), ("c", "C", "l", None, "o", ["#x"], ["t"], None, None, None, None), ("d", "A", "l", "Q", None, ["#x"], None, None, True, None, None)], SCENARIO)
    got = {r.id: r.x for r in rows.select("id", sc.problems().alias("x")).collect()}
    assert got["a"] == [] and got["d"] == [] and got["c"] == ["tier C must not assert translated text"] and len(got["b"]) == 6
    assert [r.passage for r in sc.covered_passages(rows).collect()] == ["P"] and [r.id for r in sc.blocked(rows).collect()] == ["d"]
    result = "id string, ord int, fatal string, error string, body_errors int, after_errors int, require_missing array<string>, introduced array<string>, leaks array<string>, target_found array<string>, source_present array<string>, overlay struct<open: boolean, content_length: int, name: string>, interaction struct<error: string, applied: boolean, narrowed: boolean>, text_length int"
    results = spark.createDataFrame([("a", 0, "boom", None, 0, 0, [], [], [], [], [], None, None, 1), ("a", 1, None, None, 0, 0, [], [], [], ["t"], [], None, None, 9), ("b", 0, None, None, 2, 0, ["#q"], [], ["entityNoise"], [], [], None, (None, True, False), 3), ("c", 0, None, "e", 0, 0, [], ["x"], [], [], [], (False, 0, "p"), None, 4)], result)
    checked = sc.verdicts(rows, results)
    got = {r.id: r.failures for r in checked.collect()}
    assert got["a"] == [] and got["d"] == ["no-result"]
    assert got["b"] == ["js-errors:2", "missing-selectors:#q", "leak:entityNoise", "filter-did-not-narrow"]
    assert got["c"] == ["e", "visible-error-introduced:x", "overlay-not-open", "overlay-empty", "overlay-mismatch:p"]
    assert {(r.tier, r.total, r.passed) for r in sc.summary(checked).collect()} == {("A", 2, 1), ("B", 1, 0), ("C", 1, 0)}
    expected = spark.createDataFrame([("a", "P", "ein"), ("a", "P", "kein")], "id string, passage string, needle string")
    texts = spark.createDataFrame([("P", "eins"), ("Q", "kein")], "passage string, text string")
    assert [r.needle for r in sc.unmet_expectations(expected, texts).collect()] == ["kein"]
    both = spark.createDataFrame([(["a", "b", "a"], ["a"])], "p array<string>, b array<string>")
    new, old = sc.visible_errors(both.p, both.b)
    assert tuple(both.select(new.alias("n"), old.alias("o")).first()) == (["b"], ["a", "a"])
    text = spark.createDataFrame([("<<x>> ⟦0⟧ [[ &lt;&lt; ${a} $b é",)], "t string")
    assert text.select(sc.leaks(text.t).alias("x")).first().x == ["rawMacro", "placeholder", "unresolvedLink", "entityNoise", "templateLiteral", "dollarVariable"]
    assert text.select(sc.diagnostics(text.t).alias("x")).first().x.words == 7


def test_import_stream(spark, tmp_path):
    schema = "unit_id string, translation string, ord int"
    for n, rows in enumerate(([("a", "1", 0), ("b", "2", 1)], [("a", "3", 0), ("c", "4", 1), ("c", "5", 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        imports.upsert_stream(stream, str(tmp_path / "state"), str(tmp_path / "check")).awaitTermination()
    assert {(r.unit_id, r.translation) for r in imports.current_state(spark, str(tmp_path / "state"), 2).collect()} == {("a", "3"), ("b", "2"), ("c", "5")}


def test_event_windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert imports.event_windows(events).agg(F.sum("n")).first()[0] == events.count()


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_without_gaps_on_many_wide_rows(spark, tmp_path, adaptive):
    """Written out: counts and places come from one sorted table, so no row is lost and no number repeats."""
    from textloom.operators.kit import numbered

    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        n = 200_000
        rows = spark.range(0, n, 1, 23).select((F.col("id") * 7919 % n).alias("k"), (F.col("id") % 3).alias("g"), F.repeat(F.lit("wide "), 30).alias("text"), F.col("id").cast("string").alias("s"))
        numbered(rows, ("g", "k")).write.parquet(str(tmp_path / "out"))
        out = spark.read.parquet(str(tmp_path / "out"))
        got = out.agg(F.count("*").alias("n"), F.countDistinct("row_index").alias("d"), F.min("row_index").alias("low"), F.max("row_index").alias("high")).first()
        assert tuple(got) == (n, n, 0, n - 1)
        steps = out.select("row_index", F.struct("g", "k").alias("x")).sort("row_index").toPandas()["x"].tolist()
        assert steps == sorted(steps)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_line_offsets_of_long_and_odd_texts(spark):
    from textloom.plans.base import lines

    texts = [None, "", "\n", "a", "é\n\n😀b\n", "\n".join("x" * (i % 7) for i in range(1000))]
    got = {(r.doc_id, r.i): (r.line, r.start_offset) for r in lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want, n = {}, 0
    for d, t in enumerate(texts):
        at = 0
        for i, line in enumerate((t or "").split("\n")):
            want[d, i] = (line, at)
            at += len(line) + 1
    assert got == want


def test_bag_deltas_and_equal_signatures(spark):
    from textloom.operators import tokens as tk

    bags = spark.createDataFrame([(1, ["x", "y", "x"], ["y", "z"]), (2, [], []), (3, None, ["q"])], "k long, a array<string>, b array<string>")
    assert sorted(tuple(r) for r in tk.bag_deltas(bags, "k").collect()) == [(1, "x", -2), (1, "z", 1), (3, "q", 1)]
    rows = [("m", "i", "p", "a", "b", "o", ["r", "s"], []), ("n", "i", "p", "a", "b", "o", ["s", "r"], []), ("o", "i", "p", "a", "c", "o", ["s", "r"], [])]
    signs = spark.createDataFrame(rows, "name string, id string, persistence string, argument string, branch string, output string, reads array<string>, writes array<string>")
    pairs = spark.createDataFrame([("m", "n"), ("m", "o"), ("m", "z"), ("z", "z"), (None, "m")], "a string, b string")
    for most in (0, 10):
        assert {(r.a, r.b): r.same for r in tk.equivalent(signs, pairs, most).collect()} == {("m", "n"): True, ("m", "o"): False, ("m", "z"): False, ("z", "z"): False, (None, "m"): False}


def test_valid_units_of_a_text_that_repeats_itself_are_all_planned(spark, tmp_path):
    from tests.oracle import check
    from textloom.plans.queries import ORACLES, QUERIES

    words = " ".join(f"word{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(60)) + ".\n" + " ".join(f"tail{chr(97 + n)}" for n in range(20))
    docs = [(1, " ".join([words] * 5), "en", "web", 0), (2, "one line\nand another", "en", "web", 0), (3, " ".join([words] * 40), "en", "web", 0)]
    for name, rows, kind in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", [(n, 1, 0) for n in (1, 2, 3)], "doc_id long, quality int, toxic int"), ("benchmark", [(0, "x")], "item_id long, text string")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("plan_totals", "plan_coverage"):
        check(spark, str(tmp_path), QUERIES[name], ORACLES[name])
