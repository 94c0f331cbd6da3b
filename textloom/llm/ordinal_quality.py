"""Text quality as an ordinal regression on graded ratings with cumulative links.

P(grade <= k) = sigmoid(theta_k - w . x): all grades share the weights w of hashed text features, and the thresholds theta
are kept in order by construction.  A fitted model gives each text its expected grade and its tail probability, the chance
of at least grade ``tail``, by which texts are selected.

Features are the presence of lower-cased words, of runs of other signs and of the first four and five letters of longer
words, hashed to 2**20 places, and the text's shares of capitals, digits, signs and repeated neighbours, in steps.  Places that fewer than
``MIN_DOCS`` training texts hold are left out, so a long text doesn't gather the noise of rare words.  The fit is a full-batch
Adam in one task on at most ``max_train`` labelled rows, those with the least hash of their id; the model is sparse and
bounded by the sample.

Defined results: a null text counts as empty and has its shape features alone; rows with a null grade aren't learned from; with
no labelled row or only one grade, every text gets the middle of the grades; equal texts get equal results; texts of any length
are read whole; an empty table gives an empty result; other columns pass as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


PLACES, MIN_DOCS, MAX_TRAIN = 1 << 20, 8, 6000
STEPS, RATE, DECAY, BALANCE = 250, 0.05, 2e-4, 0.5
PIECE = 1 << 20
_TOKENS, _SPACE = re.compile(r"\w+|[^\w\s]+"), re.compile(r"\s")


def _pieces(text: str) -> Iterator[str]:
    """The text cut at white space into parts of about PIECE characters."""
    a = 0
    while a < len(text):
        end = _SPACE.search(text, a + PIECE) if a + PIECE < len(text) else None
        b = end.end() if end else len(text)
        yield text[a:b]
        a = b


def tokens(text: str | None) -> dict[str, float]:
    """Feature names and values of a text."""
    text = text or ""
    counts: Counter[str] = Counter()
    repeats, last = 0, None
    upper = letters = digits = space = 0
    for part in _pieces(text):
        found = _TOKENS.findall(part.lower())
        counts.update(found)
        repeats += sum(a == b for a, b in zip([last, *found], found))
        last = found[-1] if found else last
        chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        ascii_ = np.bincount(np.minimum(chars, 128), minlength=129)
        upper += int(ascii_[65:91].sum())
        letters += int(ascii_[65:91].sum() + ascii_[97:123].sum() + ascii_[128])
        digits += int(ascii_[48:58].sum())
        space += int(ascii_[9:14].sum() + ascii_[32])
    n, total = len(text), sum(counts.values())
    out = dict.fromkeys(counts, 1.0)
    for w in counts:
        if len(w) > 5:
            out["\1" + w[:4]] = out["\2" + w[:5]] = 1.0
    shares = {"upper": upper / max(1, letters), "digit": digits / max(1, n), "sign": (n - letters - digits - space) / max(1, n), "repeat": repeats / max(1, total), "length": min(1.0, math.log10(1 + total) / 5)}
    for k, v in shares.items():
        out[f"\0{k} {int(10 * v)}"] = 1.0
    return out


def _place(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 11) % PLACES


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_rows(texts: list[str | None], grades: np.ndarray, n_grades: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, weights, thresholds) of the model."""
    columns, values, sizes = [], [], []
    for t in texts:
        row: dict[int, float] = {}
        for w, v in tokens(t).items():
            p = _place(w)
            row[p] = row.get(p, 0.0) + v
        columns.append(np.fromiter(row.keys(), np.int64, len(row)))
        values.append(np.fromiter(row.values(), np.float64, len(row)))
        sizes.append(len(row))
    col, val, of = np.concatenate(columns), np.concatenate(values), np.repeat(np.arange(len(texts)), sizes)
    held = np.bincount(col, minlength=PLACES) >= min(MIN_DOCS, len(texts))
    ok = held[col]
    places, col = np.unique(col[ok], return_inverse=True)
    val, of = val[ok], of[ok]
    weight = (len(texts) / np.maximum(1, np.bincount(grades, minlength=n_grades)))[grades] ** BALANCE
    weight /= weight.sum()
    w, theta = np.zeros(len(places)), np.concatenate([[-1.0], np.zeros(max(0, n_grades - 2))])
    params = [w, theta]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    rows = np.arange(len(texts))
    for step in range(1, STEPS + 1):
        cuts = np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))])
        s = np.bincount(of, w[col] * val, len(texts))
        below = np.concatenate([np.zeros((len(s), 1)), _sigmoid(cuts[None, :] - s[:, None]), np.ones((len(s), 1))], 1)
        slope = below * (1 - below)
        p = np.maximum(below[rows, grades + 1] - below[rows, grades], 1e-12)
        hi, lo = weight * slope[rows, grades + 1] / p, weight * slope[rows, grades] / p
        g_cut = -np.bincount(grades, hi, n_grades)[: n_grades - 1] + np.bincount(grades, lo, n_grades)[1:]
        back = np.cumsum(g_cut[::-1])[::-1]
        g_theta = np.concatenate([[back[0]], back[1:] * np.exp(theta[1:])])
        g_w = np.bincount(col, (hi - lo)[of] * val, len(places)) + DECAY * w
        for k, g in enumerate((g_w, g_theta)):
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
    cuts = np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))])
    return places, w, cuts


def fit(docs: DataFrame, grades: DataFrame, n_grades: int, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> dict | None:
    """The model from texts (id, text) and ratings (id, grade from 0 to n_grades - 1), or None without two grades to tell apart."""
    sample = grades.where(F.col(grade_col).between(0, n_grades - 1)).select(F.xxhash64(F.lit(3), id_col).alias("order"), F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade"))
    sample = sample.orderBy("order", "id", "grade").limit(max_train)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(sample), "id")  # at most max_train rows are sent to all tasks

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "grade", "text"], kind="stable")
        grades = pdf["grade"].to_numpy(np.int64)
        if len(np.unique(grades)) < 2:
            return pd.DataFrame({"places": [], "weights": [], "cuts": []}).astype(object)
        places, w, cuts = fit_rows([t if isinstance(t, str) else None for t in pdf["text"]], grades, n_grades)
        return pd.DataFrame({"places": [places], "weights": [w], "cuts": [cuts]})

    found = sample.groupBy(F.lit(1).alias("all")).applyInPandas(learn, "places array<long>, weights array<double>, cuts array<double>").collect()
    return {"weights": dict(zip(found[0].places, found[0].weights)), "cuts": list(found[0].cuts)} if found else None


def score(docs: DataFrame, model: dict | None, n_grades: int, tail: int, text_col: str = "text", name: str = "quality") -> DataFrame:
    """``docs`` with a struct ``name``: expected_grade and tail_prob; a column of that name is replaced, others pass as they are."""

    @F.pandas_udf("struct<expected_grade: double, tail_prob: double>")
    def grade(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for part in parts:
            sums = []
            for t in part:
                total = 0.0
                if model is not None:
                    for w, v in tokens(t if isinstance(t, str) else None).items():
                        if (x := known.get(w)) is None:
                            if len(known) > 500_000:
                                known.clear()
                            x = known[w] = model["weights"].get(_place(w), 0.0)
                        if x:
                            total += x * v
                sums.append(total)
            if model is None:
                yield pd.DataFrame({"expected_grade": [(n_grades - 1) / 2] * len(part), "tail_prob": [0.5] * len(part)})
                continue
            above = 1 - _sigmoid(np.array(model["cuts"])[None, :] - np.array(sums)[:, None])
            yield pd.DataFrame({"expected_grade": above.sum(1), "tail_prob": above[:, tail - 1]})

    return docs.withColumn(name, grade(F.col(text_col)))
