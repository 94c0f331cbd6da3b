import zlib
from collections import Counter

import numpy as np

from textloom.llm import language_id
from textloom.llm.language_id import DIMENSIONS, Vectors, bundles, held_out, identify, learn
from textloom.llm.queries import op3_language_id


def brute(text, vectors):
    points = [ord(c) if c.isalpha() else 0 for c in "\0" + text.lower() + "\0"]
    total = np.zeros(DIMENSIONS)
    for a, b, c in zip(points, points[1:], points[2:]):
        if b:
            total += np.roll(vectors.letter(a), 2) * np.roll(vectors.letter(b), 1) * vectors.letter(c)
    return total


def test_bundles_match_brute_force(monkeypatch):
    texts = ["The cat", None, "", "12 + 3", "ÀÉß ĳ Жуk", "a", "x1y", "word " * 40, "中文字"]
    v = Vectors()
    for chunk in (1 << 19, 16, 7):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        assert np.array_equal(bundles(texts, v), np.stack([brute(t or "", v) for t in texts]))
    many = ["".join(chr(0x4E00 + 7 * i + j) for j in range(9)) for i in range(300)]
    assert np.array_equal(bundles(many, v), np.stack([brute(t, v) for t in many]))


def test_learning_adds_up_all_training_texts(spark):
    rows = [("x", "abc abd"), ("x", "abc"), ("y", "zzz q"), (None, "nn"), ("y", None)]
    got = learn(spark.createDataFrame(rows, "lang string, text string"))
    v = Vectors()
    assert np.array_equal(got["x"], brute("abc abd", v) + brute("abc", v)) and np.array_equal(got["y"], brute("zzz q", v))


def test_whole_table_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op3_language_id(spark, sf).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(truth))
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in out]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "p"), (None, "123 !", "q"), (3, "abcabc", "r"), (3, "abcabc", "r")], "doc_id long, text string, lang_pred string")
    got = [(r.lang_pred, tuple(r.language)) for r in identify(df, {"b": brute("abc", Vectors()), "a": brute("abc", Vectors())}).collect()]
    assert got[:2] == [("p", ("und", 0.0)), ("q", ("und", 0.0))] and got[2] == got[3] and got[2][1][0] == "a"
    assert {r.language.lang_pred for r in identify(df, {}).collect()} == {"und"}
    assert identify(df.limit(0), {}).count() == 0
    assert [r.h for r in df.select(held_out().alias("h")).collect()] == [zlib.crc32(b"1") % 4 == 2, False] + [zlib.crc32(b"3") % 4 == 2] * 2
    assert learn(df.limit(0).withColumn("lang", df.lang_pred)) == {}


def test_a_column_named_like_the_result_is_replaced(spark):
    df = spark.createDataFrame([(1, "123", "old", 7.0)], "doc_id long, text string, language string, score double")
    assert identify(df, {}).select("language.lang_pred", "score").collect() == [("und", 7.0)]
