import random

from textloom.functions import patching as pt


def unit(n, text, start, raw, to):
    return {"unit_id": str(n), "start_offset": start, "end_offset": start + len(raw), "raw_text": raw, "to": to}


def test_uniform_repeats_become_one_entry():
    text = "A bell. B bell."
    plan = pt.plan_passage(text, [unit(1, text, 2, "bell", "gong"), unit(2, text, 10, "bell", "gong")])
    assert [(e.frm, e.all, e.units) for e in plan.entries] == [("bell", True, ["1", "2"])] and plan.covered["2"] == ("1", "duplicate-superseded")


def test_different_translations_get_anchors():
    text = "A bell. B bell."
    plan = pt.plan_passage(text, [unit(1, text, 2, "bell", "gong"), unit(2, text, 10, "bell", "chime")])
    assert pt.replay(text, plan.entries) == "A gong. B chime." and plan.stats["anchored"] == 2 and all(len(e.frm) <= 6 for e in plan.entries)


def test_bad_spans_and_overlaps_are_skipped():
    plan = pt.plan_passage("one two", [unit(1, "", 0, "one", "x"), unit(2, "", 2, "e two", "y"), unit(3, "", 4, "twO", "z"), unit(4, "", 90, "q", "z")])
    assert sorted(r for _, r, _ in plan.skipped) == ["overlap", "span-mismatch", "span-mismatch"] and len(plan.entries) == 1


def test_missing_passage_and_failures():
    e = pt.Entry("u", "a", "a", (0, 1), (0, 1), [(0, 1)], ["u"], [], "b")
    assert [c for c, _ in pt.failures(None, [e])] == ["PASSAGE_MISSING"]
    assert {c for c, _ in pt.failures("aba", [e])} == {"NO_OP", "SPAN_MISMATCH", "ALL_FLAG_MISSING"}


def test_random_passages_replay_exactly():
    rng = random.Random(4)
    for _ in range(400):
        text, units = "", []
        for w in rng.choices(["the cat", "sat", "on", "the mat", "a dog ran", "x"], k=rng.randrange(3, 14)):
            if rng.random() < 0.7:
                units.append(unit(len(units), "", len(text), w, rng.choice([w.upper(), w + "y", "Z"])))
            text += w + rng.choice([" ", ",", "."])
        plan = pt.plan_passage(text, units)
        placed = {u for e in plan.entries for u in e.units}
        want = pt.exchange(text, [(u["start_offset"], u["end_offset"], u["to"]) for u in units if u["unit_id"] in placed])
        assert pt.replay(text, plan.entries) == want
        assert placed | {u for u, _, _ in plan.skipped} == {u["unit_id"] for u in units}


def test_a_text_that_repeats_itself_is_one_entry_if_that_is_allowed():
    rng = random.Random(5)
    words = " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(30)) + ".\n" + " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(20))
    for times in (5, 40):  # the second is longer than a cluster may grow
        text, units, at = " ".join([words] * times), [], 0
        for line in text.split("\n"):
            units.append(unit(len(units), "", at, line, line + " zz"))
            at += len(line) + 1
        assert pt.plan_passage(text, units).entries == [] or any(r == "patch-conflict-multi-site" for _, r, _ in pt.plan_passage(text, units).skipped)
        plan = pt.plan_passage(text, units, whole=True)
        assert set(plan.covered) == {u["unit_id"] for u in units} == {u for e in plan.entries for u in e.units}
        assert pt.replay(text, plan.entries) == "\n".join(line + " zz" for line in text.split("\n")) and pt.failures(text, plan.entries) == []
