import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from textloom.llm.piece_bpe import PieceModel, encode_texts
from textloom.llm.queries import op5_piece_bpe, piece_model_path


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


@pytest.fixture(scope="module")
def own():
    return PieceModel(piece_model_path())


def same(own, lib, texts):
    for t, (ids, decoded) in zip(texts, own.encode_decode(texts)):
        want = lib.encode(t or "")
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert decoded.decode() == lib.decode(want), t


def test_edge_texts(own, lib):
    same(own, lib, ["", None, " ", "   ", "  a  b ", "a\nb\t c", "é ﬁ①", "▁x ▁", "<s>hi</s>", "\x00a\x00", "<0x41>", "😀x", "aaaa" * 50, "abab" * 60, "�", "中文字 典"])


def test_random_texts(own, lib):
    rng = random.Random(1)
    alphabet = ["a", "b", "e", "n", "t", "h", " ", "  ", "\n", "▁", "é", "0", "=", "-", "中", "😀", "\x00", "ing", "tion", " the"]
    same(own, lib, ["".join(rng.choices(alphabet, k=rng.randrange(1, 200))) for _ in range(2000)])
    same(own, lib, ["".join(rng.choices("aeth", k=1500)) for _ in range(5)])


def test_one_very_long_word(own, lib):
    rng = random.Random(2)
    same(own, lib, ["=-" * 20000 + "".join(rng.choices("abcdefgh中文", k=20000))])


def test_cache_that_is_full_changes_nothing(own, lib, monkeypatch):
    monkeypatch.setattr("textloom.llm.piece_bpe.CACHE_WORDS", 3)
    same(own, lib, ["one two three four five six", "two three seven", "one"])


def test_query_over_the_whole_table(spark, sf_dir, lib):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = op5_piece_bpe(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        ids = lib.encode(rows[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 2), (None, "", 3), (1, "ab", 4)], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens): (r.tokens.n_tokens, list(r.tokens.ids)) for r in encode_texts(df, piece_model_path(), keep_ids=True).collect()}
    assert got[1, 2] == (2, [1, 2]) and got[None, 3] == (2, [1, 2]) and got[1, 4][1][1:-1]
    assert encode_texts(df.limit(0), piece_model_path()).count() == 0
