"""Exact top-k by inner product with M-tree best-first search.

Components become floor(64 x); the score of a query and a candidate is the integer inner product.  With one more coordinate
that lifts all candidates of a tree to one norm, a larger score is a smaller Euclidean distance, which is a metric, so an M-tree
answers the search exactly.  A node is a page of at most ``PAGE`` entries; each entry keeps its covering radius and its
distance to the page's own centre.  The search takes pages in the order of the best score they could hold, stops when that is
below the k-th best found, and leaves out entries by the stored distances and the triangle inequality before any distance to
them is computed.  The queries of a block go side by side: in each round every query takes the next page of its own order, and those that take the same
page share one product of matrices.  Bounds are widened by a margin above their rounding errors; scores are exact integers.

Candidates are dealt into blocks of about ``CANDIDATES`` rows and queries into blocks of about ``QUERIES``; each pair of
blocks is a task, and a query's best of each block meet in a window that keeps k in each task before it shuffles.  Of equal
vectors only the k + 1 smallest ids can be among the first k of any query, so no more are kept, before anything is dealt.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do empty ones; vectors of another
length than the query's are no candidates; rows with the query's vec_id are its own and no candidates of it; a query's row that
repeats is answered once; rows without vec_id are candidates that come after all others of their score, and no queries;
components of which 64 times is beyond double are held at its limits, scores beyond 64 bits at the limits of long; the id 2^63 - 1 stands for none; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE, FAN, CANDIDATES, QUERIES = 256, 64, 8192, 4096
NO_ID = np.iinfo(np.int64).max
MOST = np.finfo(np.float64).max
RANGE = (np.iinfo(np.int64).min, np.iinfo(np.int64).max)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the rows of a and those of b."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


class Page:
    """Entries: rows of a leaf, or pages with the centres and covering radii; to_centre has their distances to the page's centre."""

    __slots__ = ("rows", "pages", "centres", "radii", "to_centre", "points", "ids")


class MTree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        square = (vectors * vectors).sum(1)
        self.root = self.points = None
        if not np.isfinite(square).all():  # distances are beyond double: every candidate is scored
            self.points, self.top, self.exact, self.computed = vectors, np.inf, False, 0
            return
        self.top = float(square.max())
        self.eps = 1e-6 * np.sqrt(self.top + 1)
        self.lifted = np.concatenate([vectors, np.sqrt(self.top - square)[:, None]], 1)
        self.exact = vectors.shape[1] * np.abs(vectors).max() ** 2 < 2**53
        small = vectors.shape[1] * np.abs(vectors).max() ** 2 < 2**24  # then single precision is exact too
        self.points = vectors.astype(np.float32) if small else vectors
        self.computed = 0
        self.centre = self.lifted.mean(0)
        self.root = self._page(np.arange(len(vectors)), self.centre)

    def _page(self, rows: np.ndarray, centre: np.ndarray) -> Page:
        page = Page()
        page.rows = page.pages = None
        if len(rows) <= PAGE:
            page.rows, page.points, page.ids = rows, self.points[rows], self.ids[rows]
            page.to_centre = _distances(self.lifted[rows], centre[None])[:, 0]
            return page
        # the first pivot is the row farthest from the centre; each next one is farthest from those before it
        to = _distances(self.lifted[rows], centre[None])[:, 0]
        pivots = [int(to.argmax())]
        near = _distances(self.lifted[rows], self.lifted[rows[pivots]])[:, 0]
        owner = np.zeros(len(rows), np.int64)
        while len(pivots) < min(FAN, -(-len(rows) // PAGE) + 1):
            pivots.append(int(near.argmax()))
            d = _distances(self.lifted[rows], self.lifted[rows[pivots[-1:]]])[:, 0]
            closer = d < near
            owner[closer], near[closer] = len(pivots) - 1, d[closer]
        kept = [k for k in range(len(pivots)) if (owner == k).any()]
        page.centres = self.lifted[rows[[pivots[k] for k in kept]]]
        page.radii = np.array([near[owner == k].max() for k in kept])
        page.to_centre = to[[pivots[k] for k in kept]]
        page.pages = [self._page(rows[owner == k], c) for k, c in zip(kept, page.centres)]
        return page

    def _scores(self, points: np.ndarray, query: np.ndarray) -> np.ndarray:
        most = len(query) * np.abs(query).max() * np.sqrt(self.top)
        if points.dtype == np.float32 and most < 2**24:
            return (points @ query.astype(np.float32)).astype(np.int64)
        if self.exact and most < 2**53:
            return (points.astype(np.float64) @ query).astype(np.int64)
        whole = [int(x) for x in query]
        return np.array([min(max(sum(int(a) * b for a, b in zip(p, whole)), RANGE[0]), RANGE[1]) for p in points], np.int64)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, best first, without rows of the id ``own``."""
        lifted, square = np.append(query, 0.0), float((query * query).sum())
        if self.root is None or not np.isfinite(square):
            other = self.ids != own
            ids, scores = self.ids[other], self._scores(self.vectors[other], query)
            self.computed += len(ids)
            order = np.lexsort((ids, np.invert(scores)))[:k]  # the complement turns the order around, without overflow
            return ids[order], scores[order]
        slack = 1e-9 * (square + self.top) + 1e-6

        def reach(worst: float) -> float:
            """The distance beyond which no candidate can have this score."""
            rest = square + self.top + 2 * slack - 2 * worst
            return float(np.sqrt(rest)) + self.eps if rest >= 0 else -1.0

        ids, scores, worst, limit = np.zeros(0, np.int64), np.zeros(0, np.int64), None, np.inf
        queue, nth = [(0.0, 0, float(np.sqrt(((lifted - self.centre) ** 2).sum())), self.root)], 0
        while queue:
            nearest, _, distance, page = heapq.heappop(queue)
            if nearest > limit:
                break
            to_own = np.abs(page.to_centre - distance)
            if page.pages is not None:
                at = np.flatnonzero(to_own - page.radii <= limit)
                d = np.sqrt(((page.centres[at] - lifted) ** 2).sum(1))
                self.computed += len(at)
                least = np.maximum(d, to_own[at]) - page.radii[at]
                for i in np.flatnonzero(least <= limit):
                    nth += 1
                    heapq.heappush(queue, (float(least[i]), nth, float(d[i]), page.pages[at[i]]))
                continue
            near = to_own <= limit
            points, names = (page.points, page.ids) if near.all() else (page.points[near], page.ids[near])
            got = self._scores(points, query)
            self.computed += len(names)
            ok = names != own if worst is None else (got >= worst) & (names != own)
            if not ok.any():
                continue
            ids, scores = np.concatenate([ids, names[ok]]), np.concatenate([scores, got[ok]])
            order = np.lexsort((ids, np.invert(scores)))[:k]
            ids, scores = ids[order], scores[order]
            if len(ids) == k:
                worst = int(scores[-1])
                limit = reach(worst)
        return ids, scores

    def search_all(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, ids, scores) of what ``search`` finds for each query; each takes pages in its own order, those on one page together."""
        square = (queries * queries).sum(1)
        most = queries.shape[1] * np.abs(queries).max(1) * np.sqrt(self.top)
        plain = np.isfinite(square) & (most < (2**24 if self.points.dtype == np.float32 else 2**53)) if self.root is not None and self.exact else np.zeros(len(queries), bool)
        out = []
        for i in np.flatnonzero(~plain):
            ids, scores = self.search(queries[i], int(own[i]), k)
            out.append((np.full(len(ids), i), ids, scores))
        at = np.flatnonzero(plain)
        if len(at):
            out.append(self._together(queries[at], own[at], square[at], k))
            out[-1] = (at[out[-1][0]], *out[-1][1:])
        return tuple(np.concatenate(x) for x in zip(*out))

    def _together(self, queries: np.ndarray, own: np.ndarray, square: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pages, children = [self.root], {}
        for n, page in enumerate(pages):  # grows while it is read
            children[n] = range(len(pages), len(pages) + len(page.pages or []))
            pages.extend(page.pages or [])
        n_q = len(queries)
        lifted, points = np.concatenate([queries, np.zeros((n_q, 1))], 1), queries.astype(self.points.dtype)
        slack = 1e-9 * (square + self.top) + 1e-6
        nearest, distance = np.full((n_q, len(pages)), np.inf), np.zeros((n_q, len(pages)))
        nearest[:, 0], distance[:, 0] = 0, np.sqrt(((lifted - self.centre) ** 2).sum(1))
        limit, worst = np.full(n_q, np.inf), np.full(n_q, -np.inf)
        of, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
        open_ = np.arange(n_q)
        while len(open_):
            taken = nearest[open_].argmin(1)
            bound = nearest[open_, taken]
            go = (bound <= limit[open_]) & np.isfinite(bound)
            open_, taken = open_[go], taken[go]
            new = []
            for n in np.unique(taken):
                g, page = open_[taken == n], pages[n]
                to_own = np.abs(page.to_centre[None, :] - distance[g, n][:, None])
                nearest[g, n] = np.inf
                if page.pages is not None:
                    self.computed += len(g) * len(page.pages)
                    for i, child in enumerate(children[n]):
                        d = np.sqrt(((lifted[g] - page.centres[i]) ** 2).sum(1))
                        least = np.maximum(d, to_own[:, i]) - page.radii[i]
                        nearest[g, child], distance[g, child] = np.where(least <= limit[g], least, np.inf), d
                    continue
                got = points[g] @ page.points.T
                near = to_own <= limit[g][:, None]
                self.computed += int(near.sum())
                got[~near | (page.ids[None, :] == own[g][:, None]) | (got < worst[g][:, None])] = -np.inf
                if got.shape[1] > k:
                    got[got < np.partition(got, got.shape[1] - k, 1)[:, got.shape[1] - k][:, None]] = -np.inf
                row, column = np.nonzero(got > -np.inf)
                new.append((g[row], page.ids[column], got[row, column].astype(np.int64)))
            if new:
                of, ids, scores = (np.concatenate([a, *b]) for a, b in zip((of, ids, scores), zip(*new)))
                order = np.lexsort((ids, np.invert(scores), of))
                of, ids, scores = of[order], ids[order], scores[order]
                first = np.searchsorted(of, np.arange(n_q))
                kept = np.arange(len(of)) - first[of] < k
                of, ids, scores = of[kept], ids[kept], scores[kept]
                last = np.searchsorted(of, np.arange(n_q), "right") - 1
                full = np.flatnonzero(np.bincount(of, minlength=n_q) == k)
                worst[full] = scores[last[full]]
                rest = square[full] + self.top + 2 * slack[full] - 2 * worst[full]
                limit[full] = np.where(rest >= 0, np.sqrt(np.maximum(rest, 0)) + self.eps, -1.0)
        return of, ids, scores


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dims, key): floor(64 x) as packed doubles and a digest of them, of the rows that take part."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            with np.errstate(over="ignore"):
                raw = [np.clip(np.floor(64.0 * np.asarray(v, np.float64)) + 0.0, -MOST, MOST) for v in frame["v"]]
            packed = [x.tobytes() for x in raw]
            yield pd.DataFrame({"vec_id": frame["vec_id"], "v": np.array(packed + [b""], object)[:-1], "dims": np.array([len(x) for x in raw], np.int32), "key": np.array([hashlib.md5(p).hexdigest() for p in packed] + [""], object)[:-1]})

    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0)
    return rows.where(F.coalesce(F.col("v").isNotNull() & sound, F.lit(False))).mapInPandas(pack, "vec_id long, v binary, dims int, key string")


def mtree_search(vectors: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row for which ``query``, over vec_id, holds."""
    rows = quantised(vectors, id_col, vector_col)
    least = F.dense_rank().over(Window.partitionBy("key").orderBy("vec_id"))  # a query's own id may repeat
    again = F.row_number().over(Window.partitionBy("key", "vec_id").orderBy("dims"))
    candidates = rows.withColumn("nth", least).where(F.col("nth") <= k + 1).withColumn("again", again).where(F.col("again") <= k).select("vec_id", "v", "dims", "key")
    asked = rows.where(query & (F.col("vec_id") != NO_ID)).dropDuplicates(["vec_id", "key"])
    total = rows.agg(F.count("*").alias("n"), F.count(F.when(query, 1)).alias("q")).first()
    n_c, n_q = max(1, -(-total.n // CANDIDATES)), max(1, -(-total.q // QUERIES))
    left = candidates.select("vec_id", "v", F.concat("dims", F.lit("/"), F.pmod(F.xxhash64("key"), F.lit(n_c)), F.lit("/")).alias("block"), "dims")
    left = left.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).select("vec_id", "v", "dims", F.concat("block", "q").alias("task"))
    right = asked.select("vec_id", "v", "dims", F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("c"))
    right = right.select("vec_id", "v", "dims", F.concat("dims", F.lit("/"), "c", F.lit("/"), "q").alias("task"))

    def search(of: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        if len(of) and len(queries):
            of = of.sort_values("vec_id")
            unpack = lambda f: np.frombuffer(b"".join(f["v"]), np.float64).reshape(len(f), -1)
            tree = MTree(unpack(of), of["vec_id"].to_numpy(np.int64))
            own = queries["vec_id"].to_numpy(np.int64)
            of_query, ids, scores = tree.search_all(unpack(queries), own, k)
            for c, x in zip(cols, (own[of_query], ids, scores)):
                c.append(x)
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), cols)})

    left, right = left.repartition(n_c * n_q, "task"), right.repartition(n_c * n_q, "task")  # tasks of a few megabytes that compute for long
    found = left.groupBy("task").cogroup(right.groupBy("task")).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
