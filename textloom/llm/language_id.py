"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1 that its code point seeds.  A trigram inside a word (with its edges) binds
the vectors of its letters, permuted by their place: rho(rho(a)) * rho(b) * c, rho being a rotation by one.  A text's
vector bundles (adds) its trigrams with their counts, a language's prototype those of all its training texts, and a
text gets the language whose prototype has the highest cosine with its vector.  Sums are of integers, so the prototypes don't
depend on the order of rows or tasks.

Training gathers sums alone: one vector for each task and language, added up by coordinate on the cluster; languages x
``DIMENSIONS`` numbers reach the driver (``MAX_LANGUAGES`` bounds them).  Blocks of texts are turned into a matrix of counts,
texts by distinct trigrams, and multiplied by the trigrams' vectors.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text if nothing could be learned;
the score is the cosine, not below 0; ties go to the language that sorts first; rows with a null language aren't learned
from; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


DIMENSIONS, SEED, MAX_LANGUAGES = 1024, 9, 4096
CHUNK, MAX_VECTORS = 1 << 19, 1 << 14
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


class Vectors:
    """The trigram vectors that a worker has met; the oldest go when there are too many."""

    def __init__(self):
        self.letters: dict[int, np.ndarray] = {}
        self.grams: dict[int, np.ndarray] = {}

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > MAX_VECTORS:
                self.letters.clear()
            self.letters[point] = np.random.Generator(np.random.PCG64([SEED, point])).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1
        return self.letters[point]

    def gram(self, code: int) -> np.ndarray:
        if code not in self.grams:
            if len(self.grams) > MAX_VECTORS:
                self.grams.clear()
            a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
            self.grams[code] = (np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)).astype(np.int8)
        return self.grams[code]

    def of(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([self.gram(c) for c in codes.tolist()]).astype(np.float32)


def _codes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes within words and the place of their middle letter; 0 stands for anything but a letter."""
    mid = np.flatnonzero(points[1:-1]) + 1
    p = points.astype(np.int64)
    return p[mid - 1] << 42 | p[mid] << 21 | p[mid + 1], mid


def gram_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (distinct trigram codes, texts that have any, counts: texts x codes); a long text is in several."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in lowered], np.int64)
    points = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(sizes) - sizes
    points = np.where(_letters()[points], points, np.uint32(0))
    for a in range(0, len(points) - 2, CHUNK):
        part = points[a : a + CHUNK + 2]
        codes, mid = _codes(part)
        if not len(codes):
            continue
        own = np.unique(part)
        if len(own) <= 128:  # code by place in the block's own alphabet: no sorting
            place = np.searchsorted(own, part).astype(np.int32)
            small = (place[mid - 1] * len(own) + place[mid]) * len(own) + place[mid + 1]
            seen = np.zeros(len(own) ** 3, np.int32)
            seen[small] = 1
            which = np.flatnonzero(seen)
            seen[which] = np.arange(len(which))
            column = seen[small]
            distinct = np.empty(len(which), np.int64)
            distinct[column] = codes
        else:
            distinct, column = np.unique(codes, return_inverse=True)
        doc = np.searchsorted(starts, a + mid - 1, "right") - 1
        rows, row = np.unique(doc, return_inverse=True)
        for r in range(0, len(rows), 256):
            pick = (row >= r) & (row < r + 256) if len(rows) > 256 else slice(None)
            n = min(256, len(rows) - r)
            yield distinct, rows[r : r + n], np.bincount((row[pick] - r) * len(distinct) + column[pick], minlength=n * len(distinct)).reshape(n, -1)


def bundles(texts: list[str | None], vectors: Vectors) -> np.ndarray:
    """A vector for each text."""
    out = np.zeros((len(texts), DIMENSIONS))
    for codes, rows, counts in gram_counts(texts):
        out[rows] += counts.astype(np.float32) @ vectors.of(codes)
    return out


def _parts(frame: pd.DataFrame, col: str) -> Iterator[pd.DataFrame]:
    """Slices of about CHUNK characters."""
    ends = np.cumsum([len(t) if isinstance(t, str) else 0 for t in frame[col]])
    for _, part in frame.groupby(ends // CHUNK, sort=False):
        yield part


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Language prototypes from all rows with a language."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, total = Vectors(), {}
        for frame in frames:
            for part in _parts(frame, "text"):
                langs = np.array(part["lang"], object)
                for codes, rows, counts in gram_counts([t if isinstance(t, str) else None for t in part["text"]]):
                    of = vectors.of(codes).astype(np.float64)
                    for lang in dict.fromkeys(langs[rows]):
                        total[lang] = total.get(lang, 0) + counts[langs[rows] == lang].sum(0).astype(np.float64) @ of
        rows = [(k, np.round(v).astype(np.int64)) for k, v in total.items()]
        yield pd.DataFrame(rows, columns=["lang", "vector"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInPandas(sums, "lang string, vector array<long>").select("lang", F.posexplode("vector").alias("at", "v"))
    added = parts.groupBy("lang", "at").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("v"))
    found = added.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r.lang: np.array([x.v for x in r.v], np.float64) for r in sorted(found, key=lambda r: r.lang)}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct ``name``: lang_pred and score; a column of that name is replaced, others pass as they are."""
    langs = sorted(k for k, v in prototypes.items() if v.any())
    matrix = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in langs]) if langs else np.zeros((0, DIMENSIONS))

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vectors = Vectors()
        for texts in series:
            out = []
            for part in _parts(pd.DataFrame({"text": texts}), "text"):
                x = bundles([t if isinstance(t, str) else None for t in part["text"]], vectors)
                size = np.linalg.norm(x, axis=1)
                has = (size > 0) & (len(langs) > 0)
                cos = (x @ matrix.T) / np.where(size > 0, size, 1)[:, None] if langs else np.zeros((len(x), 1))
                best = cos.argmax(1)
                out += [(langs[b], float(min(1.0, max(0.0, c[b])))) if h else (UNKNOWN, 0.0) for h, b, c in zip(has, best, cos)]
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return docs.withColumn(name, predict(F.col(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2; rows without an id are learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
