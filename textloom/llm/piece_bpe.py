"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The vocabulary is read from a .model file (identity normalisation, dummy prefix, byte fallback, as its settings say);
the library's encoder and decoder aren't used.  No piece has a space mark after another character, so texts
split into words of space marks and what follows them, and a word's result doesn't depend on its neighbours: each
distinct word of a block is encoded once.  All these words are one flat numpy array of symbols.  A round finds the least
pair rank of each word, merges its leftmost occurrence and, where no pair that this makes could rank as
early, all others of that rank with it (overlaps leftmost first), compacts the arrays, and goes on with the words that
still have a pair.  Characters without a piece become byte pieces.

Defined results: a null text counts as empty and gives the begin and end ids alone; texts of any length are encoded whole,
also a single word of any length; rows stay as they are, repeated or not; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MARK = "▁"
NONE = np.int32(2**31 - 1)
CACHE_WORDS, BLOCK_CHARS = 400_000, 1 << 20
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_LOADED: dict[str, "PieceModel"] = {}


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            sp = SentencePieceProcessor(model_proto=f.read())
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_of = [b""] * n  # what an id decodes to
        self.byte_ids = np.full(256, self.unk, np.int64)
        ids: dict[str, int] = {}
        for i, p in enumerate(names):
            if sp.is_byte(i):
                value = int(p[3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif sp.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                ids[p], self.bytes_of[i] = i, p.replace(MARK, " ").encode()
                if MARK in p.lstrip(MARK):
                    raise ValueError("a piece has a space mark after another character; words can't be split there")
        symbols = list(dict.fromkeys([*ids, *(c for p in ids for c in p)]))
        number = {p: k for k, p in enumerate(symbols)}
        self.n = len(symbols)
        self.id_of = np.array([ids.get(p, -1) for p in symbols], np.int64)
        self.char = np.full(0x110000, -1, np.int32)
        for p, k in number.items():
            if len(p) == 1:
                self.char[ord(p)] = k
        order = np.unique([-sp.get_score(i) for i in ids.values()], return_inverse=True)[1]
        keys, ranks, made = [], [], []
        for (p, _), rank in zip(ids.items(), order):
            for cut in range(1, len(p)):
                a, b = number.get(p[:cut]), number.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.n + b)
                    ranks.append(rank)
                    made.append(number[p])
        at = np.argsort(keys)
        self.keys, self.ranks, self.made = np.array(keys, np.int64)[at], np.array(ranks, np.int32)[at], np.array(made, np.int64)[at]
        self.cache: dict[str, tuple[bytes, bytes]] = {}

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NONE where there is no such piece."""
        key = a * self.n + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        ok = (self.keys[at] == key) & (a < self.n) & (b < self.n)
        return np.where(ok, self.ranks[at], NONE), self.made[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, word) of all words after all merges; symbols from self.n on are code points."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = self.char[points].astype(np.int64)
        sym = np.where(sym < 0, self.n + points, sym)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)

        def look(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at < len(sym) - 1)]
            at = at[word[at] == word[at + 1]]
            rank[at], made[at] = self.pairs(sym[at], sym[at + 1])

        look(np.arange(len(sym)))
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            ended = least == NONE
            if ended.any():
                done_sym.append(sym[ended])
                done_word.append(word[ended])
                on = ~ended
                sym, word, rank, made, least = sym[on], word[on], rank[on], made[on], least[on]
                if not len(sym):
                    break
            pos = np.flatnonzero(rank == least)
            fresh = np.concatenate([[True], (pos[1:] != pos[:-1] + 1) | (word[pos[1:]] != word[pos[:-1]])])
            nth = np.arange(len(pos)) - np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0))
            pos = pos[nth % 2 == 0]
            new, r, w = made[pos], rank[pos], word[pos]
            first = np.concatenate([[True], w[1:] != w[:-1]])
            if not first.all():
                left, right = pos - 1, np.minimum(pos + 2, len(sym) - 1)
                early = (left >= 0) & (word[left] == w) & (self.pairs(sym[left], new)[0] <= r)
                early |= (pos + 2 < len(sym)) & (word[right] == w) & (self.pairs(new, sym[right])[0] <= r)
                early[:-1] |= (pos[1:] == pos[:-1] + 2) & ~first[1:] & (self.pairs(new[:-1], new[1:])[0] <= r[:-1])
                unsafe = np.logical_or.reduceat(early, np.flatnonzero(first))[np.cumsum(first) - 1]
                pos, new = pos[first | ~unsafe], new[first | ~unsafe]
            sym[pos] = new
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            rank[pos] = NONE
            at = (np.cumsum(keep) - 1)[pos]
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            look(np.concatenate([at - 1, at]))
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def learn(self, words: list[str]) -> None:
        """Put the ids and the decoded bytes of new words into the cache."""
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.cache.clear()
        block: list[str] = []
        size = 0
        for w in words:
            block.append(w)
            size += len(w)
            if size >= BLOCK_CHARS:
                self._learn(block)
                block, size = [], 0
        if block:
            self._learn(block)

    def _learn(self, words: list[str]) -> None:
        sym, word = self.merge(words)
        known = sym < self.n
        ids = np.where(known, self.id_of[np.where(known, sym, 0)], -1)
        if (ids < 0).any():
            parts, owner = [], []
            for i, s, w in zip(ids.tolist(), sym.tolist(), word.tolist()):
                out = [i]
                if i < 0:
                    text = chr(s - self.n) if s >= self.n else self.symbol_text(s)
                    out = [int(self.byte_ids[b]) for b in text.encode("utf-8", "surrogatepass")]
                parts += out
                owner += [w] * len(out)
            ids, word = np.array(parts, np.int64), np.array(owner, np.int64)
        flat = ids.astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        ids, a = ids.tolist(), 0
        for w, b in zip(words, ends):
            self.cache[w] = flat[4 * a : 4 * b], b"".join([self.bytes_of[i] for i in ids[a:b]])
            a = b

    def symbol_text(self, s: int) -> str:
        return chr(int(np.flatnonzero(self.char == s)[0]))

    def encode_decode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """The ids without begin and end, as little-endian unsigned 32-bit integers, and their decoding in UTF-8."""
        split = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in self.cache))
        if len(self.cache) + len(new) > CACHE_WORDS:
            new = list({w for ws in split for w in ws})
        self.learn(new)
        out = []
        for ws in split:
            got = [self.cache[w] for w in ws]
            decoded = b"".join([g[1] for g in got])
            out.append((b"".join([g[0] for g in got]), decoded[1:] if decoded[:1] == b" " else decoded))
        return out


def load(path: str) -> PieceModel:
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Slices of at most about BLOCK_CHARS characters."""
    block: list[str | None] = []
    size = 0
    for t in texts:
        block.append(t)
        size += len(t or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode_texts(docs: DataFrame, model_path: str, text_col: str = "text", name: str = "tokens", keep_ids: bool = False) -> DataFrame:
    """``docs`` with a struct ``name``: n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (array<int>)."""
    kind = "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string" + (", ids: array<int>>" if keep_ids else ">")

    @F.pandas_udf(kind)
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load(model_path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (model.bos, model.eos))
        for part in parts:
            rows = []
            for block in _blocks([t if isinstance(t, str) else None for t in part]):
                for ids, decoded in model.encode_decode(block):
                    ids = begin + ids + end
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                    rows.append((*row, np.frombuffer(ids, "<u4").astype(np.int32)) if keep_ids else row)
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)
        model.cache.clear()  # the worker may do other work next

    return docs.withColumn(name, encode(F.col(text_col)))
