import numpy as np
import pytest

from textloom.llm import ordinal_quality as oq
from textloom.llm.queries import op9_ordinal_quality


def test_pieces_lose_nothing_and_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(oq, "PIECE", 5)
    text = "one two\nthree  fourfourfour five."
    assert "".join(oq._pieces(text)) == text and list(oq._pieces("")) == []
    small = oq.tokens(text)
    monkeypatch.setattr(oq, "PIECE", 1 << 20)
    assert small == oq.tokens(text)


def test_fit_keeps_thresholds_in_order_and_separates_grades():
    rng = np.random.default_rng(1)
    words = ["bad", "mid", "good"]
    grades = rng.integers(0, 3, 300)
    texts = [" ".join([words[g]] * int(rng.integers(1, 4)) + ["the", "of"]) for g in grades]
    places, w, cuts = oq.fit_rows(texts, grades, 3)
    assert cuts[0] < cuts[1]
    known = dict(zip(places.tolist(), w))
    sums = {x: sum(known.get(oq._place(k), 0) * v for k, v in oq.tokens(f"{x} the of").items()) for x in words}
    assert sums["bad"] < cuts[0] < sums["mid"] < cuts[1] < sums["good"]


def test_fit_lowers_the_likelihood_loss():
    """The loss is written out plainly here; the fit has to bring it well below that of no weights."""
    grades = np.array([0, 1, 2, 2] * 8)
    texts = ["a b", "b c", "c d", "d e"] * 8

    def loss(w, cuts, places):
        known = dict(zip(places.tolist(), w))
        total = 0.0
        for t, g in zip(texts, grades):
            s = sum(known.get(oq._place(k), 0) * v for k, v in oq.tokens(t).items())
            below = [0, *(1 / (1 + np.exp(-(c - s))) for c in cuts), 1]
            total -= np.log(below[g + 1] - below[g])
        return total

    places, w, cuts = oq.fit_rows(texts, grades, 3)
    assert loss(w, cuts, places) < loss(np.zeros_like(w), np.array([-1.0, 0.0]), places) * 0.7


def test_query_catches_toxic_rows_and_keeps_clean_ones(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op9_ordinal_quality(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    toxic = [got[r.doc_id].keep for r in labels if r.toxic]
    clean = [got[r.doc_id].keep for r in labels if not r.toxic and r.quality]
    assert np.mean(toxic) < 0.1 and np.mean(clean) > 0.95


def test_held_out_rows():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdefgh"), 8)) + (" awful" if i % 3 == 0 else " fine" if i % 3 == 2 else "") for i in range(600)]
    grades = np.arange(600) % 3
    places, w, cuts = oq.fit_rows(texts[:400], grades[:400], 3)
    known = dict(zip(places.tolist(), w))
    sums = np.array([sum(known.get(oq._place(k), 0) * v for k, v in oq.tokens(t).items()) for t in texts[400:]])
    assert (np.searchsorted(cuts, sums) == grades[400:]).mean() > 0.95


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "good good", "z"), (3, "bad", "z"), (3, "bad", "z")], "doc_id long, text string, quality string")
    none = oq.fit(docs, spark.createDataFrame([(1, 1), (2, None), (2, 7)], "doc_id long, grade int"), 3)
    assert none is None
    rows = oq.score(docs.drop("quality"), None, 3, 2).collect()
    assert {tuple(r.quality) for r in rows} == {(1.0, 0.5)}
    model = oq.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (3, 0), (9, 2)], "doc_id long, grade int"), 3)
    out = oq.score(docs, model, 3, 2, name="q").collect()
    assert [r.quality for r in out] == ["x", "y", "z", "z", "z"] and out[3].q == out[4].q and out[0].q == out[1].q
    assert all(0 <= r.q.tail_prob <= 1 and 0 <= r.q.expected_grade <= 2 for r in out)
    assert oq.score(docs.limit(0), model, 3, 2, name="q").count() == 0
    with pytest.raises(Exception):
        oq.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, grade int"), 3, text_col="absent")


def plain_fit(texts, grades, n_grades):
    """The same model in plain Python: full-batch Adam on the weighted log-likelihood, row by row."""
    rows = []
    for t in texts:
        row = {}
        for k, v in oq.tokens(t).items():
            row[oq._place(k)] = row.get(oq._place(k), 0.0) + v
        rows.append(row)
    held = {p for p in {p for r in rows for p in r} if sum(p in r for r in rows) >= min(oq.MIN_DOCS, len(rows))}
    rows = [{p: v for p, v in r.items() if p in held} for r in rows]
    share = [(len(rows) / max(1, sum(g == k for g in grades))) ** oq.BALANCE for k in range(n_grades)]
    weight = [share[g] / sum(share[g] for g in grades) for g in grades]
    w, theta = dict.fromkeys(sorted(held), 0.0), [-1.0] + [0.0] * (n_grades - 2)
    names = [*w, *range(-len(theta), 0)]
    first, second = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def cuts():
        out = [theta[0]]
        for x in theta[1:]:
            out.append(out[-1] + np.exp(x))
        return out

    for step in range(1, oq.STEPS + 1):
        c, grad = cuts(), {k: oq.DECAY * w[k] for k in w} | dict.fromkeys(range(-len(theta), 0), 0.0)
        for r, g, u in zip(rows, grades, weight):
            s = sum(w[p] * v for p, v in r.items())
            upper, lower = (sigmoid(c[g] - s) if g < n_grades - 1 else 1.0), (sigmoid(c[g - 1] - s) if g else 0.0)
            p = max(upper - lower, 1e-12)
            up, low = u * upper * (1 - upper) / p, u * lower * (1 - lower) / p
            for k, v in r.items():
                grad[k] += (up - low) * v
            for cut, x in ((g, -up), (g - 1, low)):  # a cut moves with its own step and all before it
                if 0 <= cut < n_grades - 1:
                    for k in range(cut + 1):
                        grad[k - len(theta)] += x * (1.0 if k == 0 else np.exp(theta[k]))
        for k in names:
            first[k] += 0.1 * (grad[k] - first[k])
            second[k] += 0.001 * (grad[k] ** 2 - second[k])
            move = oq.RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
            if k in w:
                w[k] -= move
            else:
                theta[k + len(theta)] -= move
    return w, cuts()


def test_fit_and_scores_match_a_plain_version(spark, sf_dir):
    """Over whole texts of the given table: the fit by plain loops, and every document's score from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text for r in docs.collect()}
    few = sorted(text)[:48]
    grade = {i: i % 3 for i in few}
    ratings = spark.createDataFrame([(i, g) for i, g in grade.items()], "doc_id long, grade int")
    model = oq.fit(docs, ratings, 3)
    w, cuts = plain_fit([text[i] for i in few], [grade[i] for i in few], 3)
    assert model["weights"].keys() == w.keys() and max(abs(model["weights"][k] - w[k]) for k in w) < 1e-3
    assert np.allclose(model["cuts"], cuts, atol=1e-3)
    for r in oq.score(docs, model, 3, 2, name="q").collect():
        s = sum(model["weights"].get(oq._place(k), 0.0) * v for k, v in oq.tokens(r.text).items())
        above = [1 - 1 / (1 + np.exp(-(c - s))) for c in model["cuts"]]
        assert r.q.expected_grade == pytest.approx(sum(above)) and r.q.tail_prob == pytest.approx(above[1])


def test_query_on_held_out_labels(spark, monkeypatch):
    """The query's own model and grades, but fitted on the labels of every other document; the rest was not seen."""
    from textloom.llm import queries

    sf, table = "/root/testdata/sf0.1", queries.table
    monkeypatch.setattr(queries, "table", lambda spark, d, name: table(spark, d, name).where("doc_id % 2 = 0") if name == "labels" else table(spark, d, name))
    got = queries.op9_ordinal_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("doc_id % 2 = 1")
    rows = got.join(labels, "doc_id").select("keep", "tail_prob", "toxic", "quality").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic and r.quality]
    print(f"held out: {len(rows)} rows, toxic kept {np.mean([r.keep for r in toxic]):.3f}, clean kept {np.mean([r.keep for r in clean]):.3f}")
    assert np.mean([r.keep for r in toxic]) < 0.15 and np.mean([r.keep for r in clean]) > 0.9
    assert len(rows) > 500


def test_a_column_named_like_the_result_is_replaced(spark):
    df = spark.createDataFrame([(1, "a", "old", 7.0)], "doc_id long, text string, quality string, tail_prob double")
    assert oq.score(df, None, 3, 2).select("quality.expected_grade", "tail_prob").collect() == [(1.0, 7.0)]
