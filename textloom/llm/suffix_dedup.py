"""Exact removal of repeated 50-byte passages with a logarithmic family of suffix arrays.

A byte is removed when a ``length``-byte string that covers it also starts in a document with a
smaller id.  Everything is judged on the input, matches stay inside one document, overlaps count.

How the work is laid out
------------------------
``texts``    Documents are dealt into batches by a hash of their id (one shuffle of the texts, reused).
``probe``    Every window of ``length`` bytes is owned by its minimiser: the smallest hash of the
             ``kgram``-byte strings in it.  A batch sends each distinct minimiser once, as packed 64-bit
             values, to the bucket that owns it; buckets answer with those that more than one batch sent.
             Only windows under a shared minimiser can repeat, so only they travel any further.  Minimisers are named by
             48 bits of their hash; two that share a name cost some more runs and change no answer.
``index``    A batch sends runs of consecutive windows under one shared minimiser, equal runs once, to the
             bucket of the minimiser.  In a bucket equal runs collapse to the smallest document (which
             settles all their other copies); of the rest, windows whose hash stands alone in the bucket repeat nowhere.
             The others, in order of document id, are taken in batches: each
             gets a suffix array cut at ``length`` bytes, is merge-scanned against the levels that exist, and
             equal-sized levels merge geometrically.  Answers are bit masks of the windows of a run.
``answer``   Masks go back to the batches, which mark the covered bytes and hash what is left.

Pair lists are never made: a passage that stands in a third of all documents costs one run for each
batch.  A run is named by its number in its batch.  Rows come out of a shuffle in any order, and in another one when they
are read again, so a batch first puts its rows in order of id and text: its runs then have the same numbers in every step.
Memory is bounded by the size of a batch or bucket; their number follows the bytes of the input.

Defined results: null texts count as empty; texts shorter than ``length`` lose nothing; rows that repeat
a doc_id are judged as parts of one document with separate results; a null doc_id counts as the id 2^63 - 1, so such rows come after
all others as one document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 50
KGRAM = 26
BATCH_WINDOWS = 1 << 16
BUCKET_BYTES = 32 << 20
NULL_ID = np.iinfo(np.int64).max
NAME_BYTES = 6
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _hashes(data: np.ndarray, k: int, begin: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the k bytes (k >= 8) that start at each position, or at those of ``begin``."""
    n = len(data) - k + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = (words[:n] if begin is None else words[begin]) * _M[0]
    for i, at in enumerate([*range(8, k - 7, 8), k - 8]):
        h ^= h >> np.uint64(29 + i % 4)
        h += words[at : at + n] if begin is None else words[begin + at]
        h *= _M[1 + i % 3]
    h ^= h >> np.uint64(32)
    h *= _M[0]
    h ^= h >> np.uint64(29)
    return h


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Smallest of the w values from each position on, by doubling."""
    size, m = 1, h
    while size * 2 <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    return np.minimum(m[: len(h) - w + 1], m[w - size :]) if w > size else m


def _distinct(h: np.ndarray) -> np.ndarray:
    """The values in order, each once; sorting is faster here than the hash table of np.unique."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of each range, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)


def _covered(starts: np.ndarray, length: int) -> np.ndarray:
    """Positions less than ``length`` after a start, by doubling."""
    out, size = starts.copy(), 1
    while size < length:
        step = min(size, length - size)
        out[step:] |= out[:-step].copy()
        size += step
    return out


def _packed(names: np.ndarray) -> bytes:
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // NAME_BYTES, 8), np.uint8)
    out[:, :NAME_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, NAME_BYTES)
    return out.view("<u8").ravel()


class Batch:
    """The texts of a batch, one after another, and their runs of windows under one minimiser."""

    def __init__(self, ids, texts, length: int, k: int):
        rows = [(NULL_ID if i is None or i != i else int(i), i is None or i != i, t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"") for i, t in zip(ids, texts)]
        rows.sort()
        raw = [r[2] for r in rows]
        self.raw, self.length = raw, length
        self.names = [None if r[1] else r[0] for r in rows]
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        data = self.data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data) - length + 1
        self.begin = self.count = self.doc = np.zeros(0, np.int64)
        self.owner = np.zeros(0, np.uint64)
        if n <= 0:
            return
        m = np.empty(n, np.uint64)
        step = 1 << 17
        for a in range(0, n, step):
            b = min(n, a + step)
            m[a:b] = _window_min(_hashes(data[a : b + length - 1], k), length - k + 1)
        cut = np.ones(n + 1, bool)
        np.not_equal(m[1:], m[:-1], out=cut[1:n])
        edges = self.starts[:-1]
        cut[edges[edges < n]] = True
        for s, z in zip(self.starts[:-1], self.sizes):  # windows that cross into the next text
            a, b = s + max(0, z - length + 1), min(s + z, n)
            if a < b:
                cut[a:b] = True
        at = np.flatnonzero(cut)
        run = np.diff(at)
        begin, owner = at[:-1], m[at[:-1]] & np.uint64((1 << 8 * NAME_BYTES) - 1)
        doc = np.searchsorted(self.starts, begin, "right") - 1
        ok = begin + length <= self.starts[doc + 1]
        begin, run, owner, doc = begin[ok], run[ok], owner[ok], doc[ok]
        if len(run) and run.max() > 32:  # a mask has 32 bits
            parts = -(-run // 32)
            of = np.repeat(np.arange(len(run)), parts)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            begin, owner, doc = begin[of] + 32 * nth, owner[of], doc[of]
            run = np.minimum(32, run[of] - 32 * nth)
        self.begin, self.count, self.owner, self.doc = begin, run, owner, doc

    def shared_here(self) -> np.ndarray:
        """Minimisers that stand in more than one document of this batch."""
        if not len(self.owner):
            return self.owner
        order = np.argsort(self.owner)
        h, d = self.owner[order], self.ids[self.doc[order]]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[first][np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)]

    def classes(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the class of each run of ``pick``, the place in ``pick`` of each class's first run): runs of a class are equal, and classes stand in the order
        of their first runs.  Runs with equal hashes are compared with the first of them byte by byte; one that differs is a class of its own."""
        begin, sizes = self.begin[pick], self.count[pick] + self.length - 1
        if not len(pick):
            return begin, begin
        heads, tails = (_hashes(self.data, self.length, x) for x in (begin, begin + sizes - self.length))
        mark, step = (heads * _M[1] ^ tails) * _M[2] + sizes.astype(np.uint64) + self.owner[pick] * _M[3], 1 << 14
        order = np.argsort(mark, kind="stable")
        head = np.concatenate([[True], mark[order][1:] != mark[order][:-1]])
        first = np.empty(len(pick), np.int64)
        first[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        again = np.flatnonzero(first != np.arange(len(pick)))
        for a in range(0, len(again), step):
            part = again[a : a + step]
            same = sizes[part] == sizes[first[part]]
            first[part[~same]] = part[~same]
            part = part[same]
            if len(part):
                differ = self.data[_ranges(begin[part], sizes[part])] != self.data[_ranges(begin[first[part]], sizes[part])]
                other = part[np.logical_or.reduceat(differ, np.cumsum(sizes[part]) - sizes[part])]
                first[other] = other
        firsts = np.flatnonzero(first == np.arange(len(pick)))
        return np.searchsorted(firsts, first), firsts


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    return (h % np.uint64(n)).astype(np.int64)


def _in(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of each group of an ordered array."""
    if len(keys):
        at = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(at[:-1], at[1:]):
            yield int(keys[a]), int(a), int(b)


class SuffixFamily:
    """Levels of suffix arrays cut at ``length`` bytes; level sizes differ by powers of two.

    ``add`` takes strings of exactly ``length`` bytes with their documents, documents never smaller than
    those added before, and returns for each the smallest document that holds it.
    """

    def __init__(self, length: int):
        self.kind, self.levels = f"S{length}", []

    @staticmethod
    def _sorted(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        head = np.concatenate([[True], k[1:] != k[:-1]])
        first = np.flatnonzero(head)
        group = np.empty(len(keys), np.int64)
        group[order] = np.cumsum(head) - 1
        return k[first], np.minimum.reduceat(docs[order], first), group

    def add(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        own, least, group = self._sorted(keys, docs)
        found = least.copy()
        for level, level_docs in self.levels:
            at = np.searchsorted(level, own)
            at[at == len(level)] = 0
            hit = level[at] == own
            found[hit] = np.minimum(found[hit], level_docs[at[hit]])
        level, level_docs = own, least
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level):
            other, other_docs = self.levels.pop()
            level, level_docs, _ = self._sorted(np.concatenate([other, level]), np.concatenate([other_docs, level_docs]))
        self.levels.append((level, level_docs))
        return found[group]


def _repeated(text: np.ndarray, begin: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, position) of each window whose hash stands twice among those of all runs, in order; the others are unlike all."""
    step = 1 << 17
    n = len(text) - length + 1
    every = np.empty(n, np.uint64)
    for a in range(0, n, step):
        every[a : a + step] = _hashes(text[a : a + step + length - 1], length)
    at = _ranges(begin, count)
    mine = every[at]
    del every
    h = np.sort(mine)
    twice = np.concatenate([h[1:] == h[:-1], [False]])
    h = _distinct(h[twice])
    run = np.repeat(np.arange(len(begin)), count)
    pick = np.flatnonzero(_in(mine, h))
    return run[pick], at[pick]


def _masks(text: np.ndarray, begin: np.ndarray, count: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Masks of the windows that a smaller document also holds, for runs in order of document."""
    family, out = SuffixFamily(length), np.zeros(len(begin), np.uint32)
    if not len(begin):
        return out
    views = np.lib.stride_tricks.sliding_window_view(text, length)
    run, at = _repeated(text, begin, count, length)
    for a in range(0, len(run), BATCH_WINDOWS):
        r, p = run[a : a + BATCH_WINDOWS], at[a : a + BATCH_WINDOWS]
        least = family.add(np.ascontiguousarray(views[p]).view(family.kind).ravel(), docs[r])
        hit = least < docs[r]
        np.bitwise_or.at(out, r[hit], np.uint32(1) << (p - begin[r])[hit].astype(np.uint32))
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (see the module's text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // BUCKET_BYTES))
    texts = texts.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(2 * n)).cast("int")).repartition(n, "batch")

    def probe(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = _distinct(Batch(pdf["doc_id"], pdf["text"], length, kgram).owner)
        of = _buckets(h, n)
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
        rows = [(k, key[0], _packed(h[a:b])) for k, a, b in _slices(of)]
        return pd.DataFrame(rows, columns=["bucket", "batch", "hashes"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [_unpacked(x) for x in pdf["hashes"]]
        h = np.sort(np.concatenate(each))
        shared = _distinct(h[1:][h[1:] == h[:-1]])
        rows = [(b, _packed(x[_in(x, shared)])) for b, x in zip(pdf["batch"], each)]
        return pd.DataFrame([r for r in rows if r[1]], columns=["batch", "shared"])

    def runs(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["bucket", "batch", "blob"]
        if not len(left):
            return pd.DataFrame([], columns=cols)
        x = Batch(left["doc_id"], left["text"], length, kgram)
        shared = _distinct(np.concatenate([x.shared_here(), *(_unpacked(r) for r in right["shared"])]))
        pick = np.flatnonzero(_in(x.owner, shared))
        rows = []
        of = _buckets(x.owner[pick], n)
        order = np.lexsort((x.ids[x.doc[pick]], of))
        pick, of = pick[order], of[order]
        class_, firsts = x.classes(pick)
        docs_, sizes, begin = x.ids[x.doc[pick[firsts]]], x.count[pick[firsts]] + length - 1, x.begin[pick[firsts]]
        same = (x.ids[x.doc[pick]] == docs_[class_]).astype(np.uint8)
        for bucket, a, b in _slices(of):
            p, q = np.searchsorted(firsts, [a, b])  # equal runs have one owner, so one bucket
            head = np.array([q - p, b - a], np.uint32)
            parts = [head, docs_[p:q], sizes[p:q].astype(np.uint16), (class_[a:b] - p).astype(np.uint32), pick[a:b].astype(np.uint32), same[a:b], x.data[_ranges(begin[p:q], sizes[p:q])]]
            rows.append((bucket, key[0], zstandard.compress(b"".join(v.tobytes() for v in parts), 1)))
        return pd.DataFrame(rows, columns=cols)

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces, seen = [], {}
        for blob in map(zstandard.decompress, pdf["blob"]):
            c, r = (int(v) for v in np.frombuffer(blob, np.uint32, 2))
            at, got = 8, []
            for kind, m in ((np.int64, c), (np.uint16, c), (np.uint32, r), (np.uint32, r), (np.uint8, r)):
                got.append(np.frombuffer(blob, kind, m, at))
                at += got[-1].nbytes
            docs_, sizes, class_, nth, same = got
            cuts = at + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            of = np.array([seen.setdefault(blob[p:q], len(seen)) for p, q in zip(cuts[:-1], cuts[1:])], np.int64)
            pieces.append((docs_, of, class_, nth, same))
        strings = list(seen)
        del seen
        docs_, of = (np.concatenate([p[i] for p in pieces]) for i in (0, 1))
        least = np.full(len(strings), NULL_ID, np.int64)
        np.minimum.at(least, of, docs_)
        order = np.argsort(least, kind="stable")
        sizes = np.array([len(strings[i]) for i in order], np.int64)
        text = np.frombuffer(b"".join(strings[i] for i in order), np.uint8)
        mask = np.empty(len(strings), np.uint32)
        mask[order] = _masks(text, np.cumsum(sizes) - sizes, sizes - length + 1, least[order], length)
        rows = []
        for batch, (d, o, class_, nth, same) in zip(pdf["batch"], pieces):
            full = (least[o] < d)[class_] | (same == 0)
            answer = np.where(full, np.uint32(0xFFFFFFFF), mask[o][class_])
            if (hit := answer != 0).any():
                rows.append((batch, np.concatenate([nth[hit], answer[hit]]).astype(np.uint32).tobytes()))
        return pd.DataFrame(rows, columns=["batch", "masks"])

    def answer(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        x = Batch(left["doc_id"], left["text"], length, kgram)
        starts = np.zeros(len(x.data), bool)
        for blob in right["masks"]:
            nth, mask = np.frombuffer(blob, np.uint32).reshape(2, -1)
            bits = (mask[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
            bits = bits.astype(bool) & (np.arange(32) < x.count[nth][:, None])
            starts[(x.begin[nth][:, None] + np.arange(32))[bits]] = True
        gone = _covered(starts, length)
        rows = []
        for i, raw, s, e in zip(x.names, x.raw, x.starts[:-1], x.starts[1:]):
            g = gone[s:e]
            spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(len(g) > 0 and g[0])
            kept = x.data[s:e][~g].tobytes() if spans else raw
            rows.append((i, len(raw), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        return out.astype({"doc_id": "Int64"})

    sent = texts.groupBy("batch").applyInPandas(probe, "bucket int, batch int, hashes binary").repartition(n, "bucket")
    shared = sent.groupBy("bucket").applyInPandas(meet, "batch int, shared binary")
    sent = texts.groupBy("batch").cogroup(shared.groupBy("batch")).applyInPandas(runs, "bucket int, batch int, blob binary").repartition(n, "bucket")
    masks = sent.groupBy("bucket").applyInPandas(index, "batch int, masks binary")
    return texts.groupBy("batch").cogroup(masks.groupBy("batch")).applyInPandas(answer, RESULT)
