"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; shingles are ``words`` words joined by a space, repeats
included; with fewer words the whole sequence is the one shingle, and without words the fingerprint is zero.  A bit of
the fingerprint is 1 if it is set in over half of the shingles' XXH64 values (seed 42).

Two fingerprints at most ``bits`` apart have a value in common at most half of that (rounded up) away from either.
So each distinct fingerprint emits all values within that half radius, rows are dealt by value, neighbours in the
order of a value's fingerprints are compared, and those within ``bits`` become links.  With ``bits`` 1 or 2 the fingerprints
of one value are all within 2 of each other, at most 65 of them, so links of neighbours lose nothing of a group;
for more bits all pairs under a value are verified.  Copies share a fingerprint and are one row throughout.

``near_copies`` wants a similarity of shingle sets.  Its fingerprints are grouped by the same ball hashing, and all texts of a group are compared by
their exact similarity, which settles the nearest copies.  At Jaccard similarity 0.8, 64-bit fingerprints lie 9 bits apart on average, far beyond a
ball that could be hashed, so what the fingerprints leave apart has a second, whole way: BANDS bands of ROWS least values (MinHash) of the distinct
``words``-word shingles.  A pair at similarity s misses all bands with probability (1 - s^ROWS)^BANDS: 0.000005 at 0.8, less above.  Bands whose texts
are all in one component by then are closed; all that meet in the others are verified, in tasks that hold the sets of a bucket.  Texts with equal
sets are one node throughout.

Defined results: null texts count as empty; documents without words link with each other; rows that repeat a doc_id give
a row each; a null doc_id is never a component's id unless all ids of the component are null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from random import Random

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import by_task, drop, written
from textloom.llm.components import components

SEED, BLOCK = 42, 1 << 16
BANDS, ROWS = 40, 6
BUCKET, COLUMNS, HUB_ROUNDS, MIN_HUB_LINKS = 256, 4096, 6, 64
_rng = Random(SEED)
FACTORS = np.array([[_rng.getrandbits(32) | 1] for _ in range(BANDS * ROWS)], np.uint32)
TERMS = np.array([[_rng.getrandbits(32)] for _ in range(BANDS * ROWS)], np.uint32)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The shingles' XXH64 values, repeats included; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.split cuts at \x20 and \x09-\x0D
    if not found:
        return np.zeros(0, "<u8")
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    k = min(words, len(found))
    start, end = (ends - sizes)[: len(found) - k + 1], ends[k - 1 :]
    xxh, out = xxhash.xxh64_intdigest, np.empty(len(start), "<u8")
    for a in range(0, len(start), BLOCK):
        s, e = start[a : a + BLOCK].tolist(), end[a : a + BLOCK].tolist()
        out[a : a + BLOCK] = np.fromiter((xxh(joined[i:j], SEED) for i, j in zip(s, e)), "<u8", len(s))
    return out


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingles with these hashes, unsigned."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[a : a + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(hashes))


def simhash(text: str | None, words: int) -> int:
    """The fingerprint, unsigned."""
    return majority(shingle_hashes(text, words))


def with_fingerprint(docs: DataFrame, words: int, text_col: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(np.array([simhash(t, words) for t in part], np.uint64).view(np.int64))

    return docs.withColumn(name, fingerprints(F.col(text_col)))


def ball(radius: int) -> list[int]:
    """Masks of at most ``radius`` of 64 bits, as signed longs."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(fps: DataFrame, bits: int) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that join all that are within ``bits``."""
    masks = F.lit(ball((bits + 1) // 2))
    near = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))
    if bits <= 2:
        before = F.lag("fp").over(Window.partitionBy("value").orderBy("fp"))
        pairs = near.select(F.col("fp").alias("u"), before.alias("v")).where("v IS NOT NULL")
    else:
        pairs = near.alias("a").join(near.alias("b"), F.expr("a.value = b.value AND a.fp > b.fp")).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits).distinct()


def simhash_groups(docs: DataFrame, words: int = 3, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable."""
    own, _ = written(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words).select("doc_id", "fp"), "fingerprints")
    least = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots, _ = components(fingerprint_links(least.select("fp"), bits))
    rooted = least.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The low 32 bits of the hashes, in order, each once."""
    low = np.sort(hashes.astype("<u4"))
    return low[np.concatenate([[True], low[1:] != low[:-1]])] if len(low) else low


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct 32-bit hashes of the shingles, in order; empty without words."""
    return distinct(shingle_hashes(text, words))


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two packed sets; 1 if both are empty."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _text_key(text_col: str) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(7), text)), 16, "0"))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """A value for each of BANDS bands of ROWS least values; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for a in range(0, len(hashes), 512):
        np.minimum(least, (FACTORS * hashes[a : a + 512] + TERMS).min(1), out=least)
    packed = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), n) for n, x in enumerate(packed)], np.uint64).view(np.int64)


def _shared(values: DataFrame) -> DataFrame:
    """(key, value, n) of the values with n > 1 keys.  Of values with the same keys one is kept: near copies have most bands in common."""
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "key")).alias(f"x{k}") for k in (1, 2)]
    buckets = values.groupBy("value").agg(F.count("*").alias("n"), *marks).where("n > 1")
    return values.join(buckets.groupBy("n", "x1", "x2").agg(F.min("value").alias("value")).select("value", "n"), "value").select("key", "value", "n")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets have in common."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    if m <= 8:
        for i, j in combinations(range(m), 2):
            out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    every = np.concatenate(sets)
    of = np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    at = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(at) - 1
    twice = np.bincount(column)[column] > 1  # a hash of one set alone meets nothing
    of, column = of[twice], np.cumsum(at[twice]) - 1
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        holds = np.zeros((m, COLUMNS), np.float32)
        holds[of[a:b], column[a:b] - first] = 1
        out += np.rint(holds @ holds.T).astype(np.int64)
    return out


def _forest(part: pd.DataFrame, least_similarity: float) -> list[tuple[bytes, bytes]]:
    """Links that join all rows of a task that are alike: for each row the least row it can reach."""
    sets = [np.frombuffer(x, "<u4") for x in part["s"]]
    sizes, kind, block = np.array([len(x) for x in sets]), int(part["kind"].iloc[0]), part["block"].to_numpy()
    both = common(sets)
    alike = both / np.maximum(sizes[:, None] + sizes[None, :] - both, 1) >= least_similarity
    if kind == 1:  # pairs of one side have tasks of their own
        side = part["main"].to_numpy()
        alike &= side[:, None] != side[None, :]
    elif kind == 0 and block.min() != block.max():
        alike &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(alike, 1))
    root = np.arange(len(sets))
    while len(i):
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    keys = list(part["key"])
    return [(keys[k], keys[r]) for k, r in enumerate(root.tolist()) if k != r]


def _compared(dealt: DataFrame, least_similarity: float) -> DataFrame:
    """(u, v) links of each task's rows; a task's rows stand together, and memory holds one task and one batch."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in by_task(frames, ["value", "i", "j", "kind"]):
            if found := _forest(part, least_similarity) if len(part) > 1 else []:
                yield pd.DataFrame(found, columns=["u", "v"])

    return dealt.mapInPandas(compare, "u binary, v binary")


def _verified(shared: DataFrame, sketches: DataFrame, least_similarity: float, block: int = BUCKET) -> DataFrame:
    """(u, v) of components, as ``components`` gives them, that join all pairs of keys under a common value whose sets are alike.

    A bucket of at most ``block`` keys is compared in one task.  In larger ones one key after another is compared with all others, a linear
    step that settles dense groups.  What a bucket's largest component then holds need not be compared with itself: the rest meets
    the rest and that component, in pairs of blocks that are tasks of their own.  No pair leaves a task, only links that keep its rows joined.
    """
    spark = shared.sparkSession
    large, roots = shared.where(F.col("n") > block).select("key", "value"), None

    def rooted(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("key"))
        return rows.join(roots.select(F.col("u").alias("key"), F.col("v").alias("root")), "key", "left").withColumn("root", F.coalesce("root", "key"))

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) >= least_similarity for x, y in zip(a, b)], dtype="bool")

    some = large.limit(1).count() > 0
    for n in range(HUB_ROUNDS if some else 0):
        rows = rooted(large)
        open_ = rows.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("value")
        order = F.xxhash64(F.lit(n), "key")
        hubs = rows.join(open_, "value").groupBy("value").agg(F.min_by(F.struct("key", "root"), order).alias("hub"))
        hubs = hubs.select("value", F.col("hub.key").alias("b"), F.col("hub.root").alias("of")).join(sketches.select(F.col("key").alias("b"), F.col("s").alias("sb")), "b")
        pairs = rows.join(hubs, "value").where("root != of").select("key", "b", "sb").join(sketches, "key")
        links, path = written(pairs.where(alike("s", "sb")).select(F.col("key").alias("u"), F.col("b").alias("v")).distinct(), "links", narrow=True)
        new = links.count()
        if new:
            roots, _ = components(links if roots is None else links.unionByName(roots))
        drop(spark, path)
        if new < MIN_HUB_LINKS:
            break
    none = F.lit(0)
    dealt = shared.where(F.col("n") <= block).select("key", "value", none.alias("i"), none.alias("j"), F.lit(2).alias("kind"), none.alias("block"), F.lit(False).alias("main"))
    if some:
        rows = rooted(large)
        parts = rows.groupBy("value", "root").agg(F.count("*").alias("n"))
        sides = parts.groupBy("value").agg(F.max_by("root", "n").alias("most"), F.max("n").alias("n_main"), F.sum("n").alias("n")).where("n > n_main")
        sides = sides.select("value", "most", F.ceil((F.col("n") - F.col("n_main")) / block).cast("int").alias("so"), F.ceil(F.col("n_main") / block).cast("int").alias("sp"))
        cut = rows.join(sides, "value").withColumn("main", F.col("root") == F.col("most"))
        cut = cut.withColumn("block", F.expr("pmod(xxhash64(key), if(main, sp, so))").cast("int"))
        tasks = F.expr("""
            CASE WHEN main THEN transform(sequence(0, so - 1), x -> named_struct('i', x, 'j', block, 'kind', 1))
                 ELSE concat(transform(sequence(0, so - 1), x -> named_struct('i', least(x, block), 'j', greatest(x, block), 'kind', 0)),
                             transform(sequence(0, sp - 1), x -> named_struct('i', block, 'j', x, 'kind', 1))) END""")
        cut = cut.select("key", "value", "block", "main", F.explode(tasks).alias("t")).select("key", "value", "t.i", "t.j", "t.kind", "block", "main")
        dealt = dealt.unionByName(cut)
    dealt = dealt.join(sketches, "key").repartition("value", "i", "j", "kind").sortWithinPartitions("value", "i", "j", "kind", "key")
    links, path = written(_compared(dealt, least_similarity), "links")
    roots, _ = components(links if roots is None else links.unionByName(roots))
    drop(spark, path)
    return roots


def _unsettled(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the buckets whose keys are not all in one component."""
    rooted = shared.join(roots.select(F.col("u").alias("key"), F.col("v").alias("root")), "key", "left").select("value", F.coalesce("root", "key").alias("root"))
    return shared.join(rooted.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high"), "value", "left_semi")


def near_copies(docs: DataFrame, words: int = 5, least_similarity: float = 0.8, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of linked texts the document with the least id stays.

    Texts are linked if they are equal or if their shingle sets are at least this similar and they meet: in a group of fingerprints, linked at ``bits`` or
    fewer bits, or in a band.
    Rows without an id stay only where their group has no id at all.
    """

    spark = docs.sparkSession

    @F.pandas_udf("struct<own: binary, fp: long, bands: array<long>>")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            own, prints, bands = [], [], []
            for text in part:
                hashes = shingle_hashes(text, words)
                prints.append(majority(hashes))
                own.append(xxhash.xxh3_128_digest((found := distinct(hashes)).tobytes()))
                bands.append(min_hashes(found))
            yield pd.DataFrame({"own": own, "fp": np.array(prints, np.uint64).view(np.int64), "bands": bands})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", _text_key("text").alias("text_key"), sketch("text").alias("x"))
    rows, rows_path = written(rows.select("doc_id", "text_key", F.col("x.own").alias("key"), F.col("x.fp").alias("fp"), F.col("x.bands").alias("bands")), "sketches")
    texts = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("least"), F.col("text_key").alias("text_key"))).alias("best"), F.first("bands").alias("bands"))
    texts, _ = written(texts, "texts", narrow=True)
    prints, prints_path = written(rows.select("key", "fp").distinct(), "fingerprints", narrow=True)  # repeats count, so texts of one set may have several
    drop(spark, rows_path)
    near, near_path = components(fingerprint_links(prints.select("fp").distinct(), bits))
    groups = prints.join(near.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("key", F.coalesce("root", "fp").alias("value")).distinct()
    groups, groups_path = written(_shared(groups), "groups", narrow=True)
    shared, shared_path = written(_shared(texts.select("key", F.explode("bands").alias("value"))), "values", narrow=True)
    for path in (prints_path, near_path):
        drop(spark, path)
    involved = shared.select("key").unionByName(groups.select("key")).distinct().join(texts.select("key", "best"), "key").select(F.col("key").alias("k"), "best.least", "best.text_key")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            packed = [shingle_set(t if isinstance(t, str) else None, words).tobytes() for t in frame["text"]]
            yield pd.DataFrame({"key": frame["k"], "s": np.array([*packed, b""], object)[:-1]})

    bodies = docs.select(F.col(id_col).alias("doc_id"), _text_key(text_col).alias("own_key"), F.col(text_col).alias("text"))
    bodies = bodies.join(involved, F.expr("own_key = text_key AND doc_id <=> least")).dropDuplicates(["k"]).select("k", "text")
    sketches, sets_path = written(bodies.mapInPandas(sets, "key binary, s binary"), "sets")
    roots = _verified(groups, sketches, least_similarity)
    rest = _verified(_unsettled(shared, roots), sketches, least_similarity)
    roots, _ = components(roots.unionByName(rest))
    for path in (groups_path, shared_path, sets_path):
        drop(spark, path)
    rooted = texts.select("key", "best").join(roots.select(F.col("u").alias("key"), F.col("v").alias("root")), "key", "left").select("best", F.coalesce("root", "key").alias("root"))
    best = rooted.groupBy("root").agg(F.min("best").alias("best"))
    stay = best.select(F.col("best.text_key").alias("__near_key"), F.col("best.least").alias("__near_id"))
    kept = docs.withColumn("__near_own", _text_key(text_col)).join(stay, (F.col("__near_own") == F.col("__near_key")) & F.col(id_col).eqNullSafe(F.col("__near_id")), "left_semi")
    return kept.dropDuplicates([id_col, "__near_own"]).drop("__near_own")
