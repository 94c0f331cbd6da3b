import json
import subprocess

import pytest
from pyspark.sql import functions as F

from textloom.sources import archive as ar
from textloom.sources import git as g
from textloom.sources import records as rec
from textloom.sources import story as st

HTML = (
    '<html><tw-storydata name="Tale" startnode="1" creator="c" name="Last"><style id="twine-user-stylesheet">p{}</style>'
    '<script type="text/twine-javascript">lost/* twine-user-script #1: "a/b.js" */x<tw-passagedata pid="9" name="no" tags="">z</tw-passagedata>/* twine-user-script #2: "c.js" */y</script>'
    '<tw-passagedata pid="1" name="Hall &amp; Co" tags="widget nobr" position="1,2">You &lt;&lt;he&gt;&gt; &amp;amp;</tw-passagedata><tw-passagedata name="Hall &amp; Co" tags="">second</tw-passagedata></tw-storydata>after'
)


def test_story_parts(spark, tmp_path):
    (tmp_path / "s.html").write_text(HTML)
    parts = st.read_story(spark, str(tmp_path / "s.html"))
    rows = {(r.part, r.name): r for r in parts.collect()}
    assert rows["story", None].attributes == {"name": "Last", "startnode": "1", "creator": "c"}
    first = parts.where("pid = 1").first()
    assert first.content == "You <<he>> &amp;" and first.tags == ["widget", "nobr"] and first.name == "Hall &amp; Co"
    assert HTML[first.content_offset :].startswith("You &lt;") and HTML[first.offset :].startswith('<tw-passagedata pid="1"')
    assert {n for p, n in rows if p == "script"} == {"a/b.js", "c.js"} and ("passage", "no") not in rows
    assert rows["script", "c.js"].content.endswith("y") and ("style", None) in rows
    passages = st.passages(parts)
    assert st.by_name(passages).first().content == "second"
    assert sorted(r.tag for r in st.by_tag(passages).collect()) == ["nobr", "widget"]


def test_a_file_without_a_story_raises():
    with pytest.raises(ValueError):
        st.parse_story("x", "<html></html>")


def test_plain_text_source(spark):
    text = "ignored\n:: First [a b] {\"position\":\"1\"}\n\nbody\n:: Second\n  tail\n:: Third[x]"
    rows = st.parse_source(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("line").collect()
    assert [(r.name, r.tags, r.line, r.raw) for r in rows] == [("First", ["a", "b"], 2, "\nbody"), ("Second", [], 5, "  tail"), ("Third", ["x"], 7, "")]


def test_state_lines(spark, tmp_path):
    lines = ['{"unitId": "a", "translation": "1"}', "", "{bad", '{"translation": "x"}', '{"unitId": "b", "translation": "2"}', '{"unitId": "a", "translation": "3"}']
    rows = rec.state_rows(spark.createDataFrame(list(enumerate(lines)), "ord long, value string"))
    assert sorted((r.unitId, r.translation) for r in rows.collect()) == [("a", "3"), ("b", "2")]
    rec.write_state(rows, str(tmp_path / "state"))
    assert rec.read_state(spark, str(tmp_path / "state")).count() == 2


def test_csv_and_jsonl(spark, tmp_path):
    text = '﻿unitId,translation\r\n1,"a ""b"", c"\r\n2,"two\r\nlines"\r\n\r\n3\r\n"""q""",\r\n'
    rows = rec.csv_records(text)
    assert [(r["unitId"], r["translation"]) for r in rows] == [("1", 'a "b", c'), ("2", "two\r\nlines"), ("3", ""), ('"q"', "")]
    (tmp_path / "s.csv").write_text(text, newline="")
    got = rec.read_segments_csv(spark, str(tmp_path / "s.csv")).collect()
    assert got[0]["translation"] == 'a "b", c'
    assert rec.jsonl_records('{"a": 1}\n\n{"a": 2}') == [{"a": 1}, {"a": 2}]
    with pytest.raises(json.JSONDecodeError):
        rec.jsonl_records("{")


@pytest.mark.parametrize(
    "text",
    ['[{"passage": "P", "from": "a", "to": "b"}]', '{"entries": [{"passage": "P", "from": "a", "to": "b"}]}', '{"typeB": {"TypeBInputStoryScript": [{"pN": "P", "f": "a", "t": "b"}]}}', '{"passage": "P", "from": "a", "to": "b"}\n{"passage": "P", "from": "a", "to": "b"}'],
)
def test_localization_shapes(spark, text):
    rows = rec.read_localization(spark.createDataFrame([("f", text)], "path string, text string")).collect()
    assert {(r.passage, r.from_text, r.to_text) for r in rows} == {("P", "a", "b")}


def test_archives():
    data = ar.pack({"a.txt": "one", "b": b"\0"})
    assert data == ar.pack({"a.txt": "one", "b": b"\0"}) and ar.member(data, "a.txt") == b"one"
    with pytest.raises(KeyError):
        ar.member(data, "c")
    with pytest.raises(ValueError):
        ar.checked(data)
    cache = ar.structure_cache({"targetStory": {"sha256": "x"}}, {"units": 1})
    assert ar.cache_compatible(cache, "x") and not ar.cache_compatible(cache, "y")
    boot = ar.pack({"boot.json": json.dumps({"addonPlugin": [{"params": {"twee": [{"passageName": "P", "from": "a", "to": "b", "all": True}]}}]})})
    assert ar.records_from_pack(boot) == [{"passage": "P", "from_text": "a", "to_text": "b", "all_sites": True}]
    with pytest.raises(ValueError):
        rec.scenario_spec('{"kind": "other"}')


def test_kits_go_out_in_chunks_and_come_back(spark, tmp_path):
    from textloom.functions.columns import MARKS_TYPE
    from textloom.operators import kit

    units = spark.createDataFrame([(0, n, f"1:{n}-{n + 1}", "P", "passage_text", "narrative", "L0", n, n + 1, f'te,"xt {n}', f"te ⟦0⟧ {n}", [("⟦0⟧", "<<he>>", "macro", "he")]) for n in range(5)], f"passage_ord int, unit_ord int, unit_id string, passage string, kind string, family string, risk_level string, start_offset int, end_offset int, raw_text string, protected_text string, placeholders {MARKS_TYPE}")
    passages = spark.createDataFrame([("P", "abcdefgh")], "name string, content string")
    dealt = kit.chunks(units, 2, ("passage_ord", "unit_ord")).select("unit_id", "chunk", "filename", "row_index")
    segs = kit.segments(units, passages).join(dealt.withColumnRenamed("unit_id", "unitId"), "unitId")
    segs = segs.withColumn("issue", F.when(F.col("row_index") == 4, F.lit('{"unitId": "1:4-5"}')))
    done = ar.write_kits(segs, str(tmp_path), {"targetStory": {"sha256": "s"}}, [("a", 'b"', "")]).collect()
    assert sorted((r.filename, r.segment_count) for r in done) == [("localization-kit-001.zip", 2), ("localization-kit-002.zip", 2), ("localization-kit-003.zip", 1)]
    assert json.loads(ar.kit_index(done, {"scope": "all"}, 2))["totalSegments"] == 5
    back = ar.read_kits(spark, str(tmp_path / "*.zip")).collect()
    assert len(back) == 10 and {r.story_sha for r in back} == {"s"} and {r.unit_id for r in back if r.part == "csv"} == {f"1:{n}-{n + 1}" for n in range(5)}
    body = ar.member((tmp_path / "localization-kit-001.zip").read_bytes(), "segments.csv").decode()
    last = (tmp_path / "localization-kit-003.zip").read_bytes()
    assert ar.member(last, "issues.jsonl") == b'{"unitId": "1:4-5"}\n' and b"problems to repair: 1" in ar.member(last, "README.md") and ar.member(last, "TRANSLATION-RULES.md")
    assert body.startswith("﻿unitId,passage") and body.count("\r\n") == 3


def test_git_tree(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "game").mkdir()
    (tmp_path / "game" / "a.twee").write_text(":: A\nx")
    (tmp_path / "readme").write_text("r")
    run("add", "-A")
    run("-c", "user.name=t", "-c", "user.email=t@example.com", "commit", "-qm", "m")
    assert [r.path for r in g.read_tree(spark, str(tmp_path), "HEAD").collect()] == ["game/a.twee", "readme"]
    assert [(r.file, r.text) for r in g.read_sources(spark, str(tmp_path), "HEAD").collect()] == [("game/a.twee", ":: A\nx")]
    assert g.read_blobs(str(tmp_path), ["HEAD:readme", "HEAD:none"]) == {"HEAD:readme": b"r", "HEAD:none": None}
    facts = g.resolve(str(tmp_path), "HEAD")
    assert len(facts["commit"]) == 40 and facts["object_type"] == "commit" and (facts["author"], facts["subject"]) == ("t", "m")
    with pytest.raises(ValueError):
        g.require_repository(str(tmp_path / "game" / "none"))
    with pytest.raises(RuntimeError):
        g.resolve(str(tmp_path), "nothing")


def test_session_folders_and_reports(tmp_path):
    from datetime import datetime

    assert ar.session_stamp(datetime(2024, 3, 5, 7, 8, 9)) == "20240305-070809"
    made = [ar.session_folder(str(tmp_path / "r"), "s") for _ in range(3)]
    assert [m.rsplit("/", 1)[1] for m in made] == ["s", "s-2", "s-3"]
    assert ar.write_json_once("{}", made[0] + "/a.json") and not ar.write_json_once("[]", made[0] + "/a.json") and open(made[0] + "/a.json").read() == "{}"


def test_a_missing_story_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        st.read_story(spark, str(tmp_path / "none.html"))
    with pytest.raises(ValueError):
        st.read_story(spark, "")


def test_a_pack_is_written_only_if_its_plan_is_sound(spark, tmp_path):
    from textloom.operators import planner as pl

    row = dict.fromkeys(pl._NAMES) | {"passage": "P", "what": "entry", "from_text": "a", "to_text": "b", "all_sites": False, "patch_start": 0, "patch_end": 1}
    good = spark.createDataFrame([tuple(row[n] for n in pl._NAMES)], pl.ROW)
    bad = good.unionByName(spark.createDataFrame([tuple((row | {"what": "failure", "reason": "NO_OP"})[n] for n in pl._NAMES)], pl.ROW))
    assert [tuple(r) for r in ar.patch_pack(bad, str(tmp_path / "bad")).collect()] == [("NO_OP", 1)] and not (tmp_path / "bad").exists()
    assert ar.patch_pack(good, str(tmp_path / "good")).count() == 0 and spark.read.json(str(tmp_path / "good")).first()["passageName"] == "P"


def test_kits_go_into_their_folder_without_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_: pytest.fail("archives at the driver"))
    columns = [F.lit("x").alias(c) for c in rec.SEGMENT_COLUMNS if c not in ("unitId", "placeholders")]
    rows = spark.range(7).select(F.col("id").cast("string").alias("unitId"), F.array().cast("array<struct<token: string, type: string, raw: string>>").alias("placeholders"), *columns, (F.col("id") / 3).cast("int").alias("chunk"), F.concat(F.lit("k"), (F.col("id") / 3).cast("int"), F.lit(".zip")).alias("filename"), F.col("id").alias("row_index"))
    for folder in (str(tmp_path / "plain"), f"file:{tmp_path}/uri"):
        done = ar.write_kits(rows, folder, {}).collect()
        made = sorted(p.name for p in (tmp_path / folder.rsplit("/", 1)[1]).iterdir())
        assert made == ["k0.zip", "k1.zip", "k2.zip"] == sorted(r.filename for r in done) and "data" not in done[0].asDict()
        assert sorted(r.unit_id for r in ar.read_kits(spark, folder).where("part = 'csv'").collect()) == [str(n) for n in range(7)]
