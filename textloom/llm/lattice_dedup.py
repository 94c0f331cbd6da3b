"""Near-duplicate vectors by E8 lattice hashing.

Each of ``TABLES`` random projections maps a unit vector to ``BLOCKS`` points of eight dimensions, which are decoded to
their nearest points of the E8 lattice; these points together are the vector's cell.  A vector owns its cell and also
probes the ``PROBES`` neighbouring cells that it lies nearest to.  Vectors that meet in a cell, at least one of them as
owner, are compared by cosine in double precision.  For a pair at cosine 0.93 one table finds about 65 %, five
99.5 %, and more at higher cosines.

Equal vectors of a label are one row with a weight throughout.  Cells are told apart by ids alone; a vector is sent only to cells in which it meets another.  A cell's vectors are compared in blocks; cells with over
``BLOCK`` owners or probers are cut into pairs of blocks that are dealt out as tasks of their own.  No pair leaves a task:
a task returns, for each vector, the weight it is linked to and one link that keeps its block's links connected.  A pair that
meets in several cells is counted in the first alone, which both vectors' cells tell.  Projections are
computed in integers within 53 bits, so a vector has the same cells wherever they are computed.

Defined results: rows whose label or vector is null, or whose vector is empty, zero or holds null or non-finite components,
link with nothing and keep their own id as component; vectors of different lengths don't link; a vec_id that
repeats is a vector of its own in each row; a null vec_id is never a component's id unless all are null; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import by_task, drop, written
from textloom.llm.components import components

TABLES, BLOCKS, PROBES, SCALE, SEED = 5, 2, 4, 3.0, 8
BLOCK = 1024
GRID = float(1 << 22)


@cache
def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for (i, j), s, t in product(combinations(range(8), 2), (1.0, -1.0), (1.0, -1.0)):
        v = np.zeros(8)
        v[i], v[j] = s, t
        out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: round, and where the sum is odd, the worst coordinate goes the other way."""
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(-1) % 2 != 0)
    e = (x - f)[odd]
    k = np.abs(e).argmax(-1)
    f[odd, k] += np.where(e[np.arange(len(odd)), k] >= 0, 1.0, -1.0)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row of eight: the better of the two cosets of D8."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1))[:, None], a, b)


@cache
def _projection(dims: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([SEED, dims]))
    wide = []
    for _ in range(TABLES):
        q = rng.standard_normal((max(dims, 8 * BLOCKS), max(dims, 8 * BLOCKS)))
        wide.append(np.linalg.qr(q)[0][:dims, : 8 * BLOCKS] * np.sqrt(dims / 64))
    return np.rint(np.concatenate(wide, 1) * GRID), rng.integers(0, 1 << 20, (TABLES, BLOCKS, 8)) / float(1 << 20)


def cells(unit: np.ndarray, labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the own cell (n x TABLES) and of the probed cells (n x TABLES x PROBES)."""
    n, dims = unit.shape
    matrix, offset = _projection(dims)
    y = np.rint(unit * GRID) @ matrix
    y = np.floor(y * (SCALE / GRID / GRID * (1 << 20))) / (1 << 20)
    y = y.reshape(n, TABLES, BLOCKS, 8) + offset
    point = nearest_e8(y.reshape(-1, 8)).reshape(y.shape)
    roots = _roots()
    own, probed = np.empty((n, TABLES), np.uint64), np.empty((n, TABLES, PROBES), np.uint64)
    heads = [f"{dims}|{x}|".encode("utf-8", "surrogatepass") for x in labels]
    doubled = np.rint(2 * point).astype(np.int16)
    double_roots = np.rint(2 * roots).astype(np.int16)
    for t in range(TABLES):
        near = ((y[:, t] - point[:, t]) @ roots.T).reshape(n, -1)
        order = np.argsort(-near, 1, kind="stable")[:, :PROBES]
        for i in range(n):
            base = doubled[i, t]
            own[i, t] = xxhash.xxh64_intdigest(heads[i] + base.tobytes(), t)
            for p in range(PROBES):
                b, r = divmod(int(order[i, p]), 240)
                other = base.copy()
                other[b] += double_roots[r]
                probed[i, t, p] = xxhash.xxh64_intdigest(heads[i] + other.tobytes(), t)
    return own, probed


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1)[:, None]
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def _by_length(vectors: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(v) for v in vectors])
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, np.stack([np.asarray(vectors[i], np.float64) for i in at])


def _cells_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gid, role, t, key): a vector's own cell (role 0) and the probed ones (role 1) in each table."""
    for frame in frames:
        labels, keys = list(frame["label"]), list(frame["key"])
        for at, block in _by_length(list(frame["v"])):
            own, probed = cells(_unit(block), [labels[i] for i in at])
            every = np.concatenate([own[:, :, None], probed], 2).reshape(len(at), -1)
            role = np.tile(np.arange(every.shape[1]) % (1 + PROBES) > 0, len(at)).astype(np.int32)
            table = np.tile(np.arange(every.shape[1]) // (1 + PROBES), len(at)).astype(np.int32)
            yield pd.DataFrame({"gid": every.ravel().view(np.int64), "role": role, "t": table, "key": [keys[i] for i in np.repeat(at, every.shape[1])]})


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The vectors as bytes, of single precision where that holds them exactly."""
    for frame in frames:
        raw, dims = [], []
        for v in frame["v"]:
            x = np.asarray(v, np.float64)
            narrow = x.astype(np.float32)
            raw.append((narrow if (narrow == x).all() else x).tobytes())
            dims.append(len(x))
        yield pd.DataFrame({"key": frame["key"], "label": frame["label"], "w": frame["w"], "v": np.array([*raw, b""], object)[:-1], "dims": np.array(dims, np.int32)})


def _links(part: pd.DataFrame, cosine: float, kind: int, out: tuple[list, list, list]) -> None:
    """Links among the rows of one task: keys, weights linked and a root go to ``out``."""
    dims = int(part["dims"].iloc[0])
    raw = list(part["v"])
    unit = _unit(np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * dims else np.float64).astype(np.float64) for x in raw]))
    role, block, t, gid = part["role"].to_numpy(), part["block"].to_numpy(), int(part["t"].iloc[0]), np.uint64(int(part["gid"].iloc[0]) % (1 << 64))
    owners, probers = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    found = []
    if kind != 1 and len(owners) > 1:
        i, j = np.nonzero(np.triu(unit[owners] @ unit[owners].T >= cosine, 1))
        i, j = owners[i], owners[j]
        if kind == 0 and len(np.unique(block[owners])) > 1:  # pairs within one of the blocks have a task of their own
            across = block[i] != block[j]
            i, j = i[across], j[across]
        found.append((i, j, np.zeros(len(i), bool)))
    if kind != 0 and len(owners) and len(probers):
        i, j = np.nonzero(unit[owners] @ unit[probers].T >= cosine)
        found.append((owners[i], probers[j], np.ones(len(i), bool)))
    if not found:
        return
    i, j, probe = (np.concatenate([f[k] for f in found]) for k in range(3))
    label = part["label"].to_numpy()
    ok = label[i] == label[j]
    i, j, probe = i[ok], j[ok], probe[ok]
    if not len(i):
        return
    used = np.unique(np.concatenate([i, j]))
    own, probed = cells(unit[used], label[used].tolist())
    counted = np.empty(len(i), bool)
    for s in range(0, len(i), 1 << 16):
        a, b = np.searchsorted(used, i[s : s + (1 << 16)]), np.searchsorted(used, j[s : s + (1 << 16)])
        meets = own[a] == own[b]
        a_in_b = (own[a][:, :, None] == probed[b]).any(2)
        b_in_a = (own[b][:, :, None] == probed[a]).any(2)
        first = ~(meets | a_in_b | b_in_a)[:, :t].any(1)
        both = a_in_b[:, t] & b_in_a[:, t] & (np.minimum(own[a][:, t], own[b][:, t]) != gid)
        counted[s : s + (1 << 16)] = first & ~(probe[s : s + (1 << 16)] & both)
    weight = part["w"].to_numpy(np.int64)
    n = np.zeros(len(part), np.int64)
    np.add.at(n, i[counted], weight[j[counted]])
    np.add.at(n, j[counted], weight[i[counted]])
    root = np.arange(len(part))
    while True:  # least reachable row
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    key = part["key"].to_numpy()
    out[0].extend(key[used])
    out[1].extend(n[used].tolist())
    out[2].extend(key[root[used]])


def lattice_dedup(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id and kept."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    sound = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & sound, F.lit(False))
    hashes = [F.lpad(F.hex(F.xxhash64(F.lit(k), "label", "v")), 16, "0") for k in (1, 2)]
    rows = rows.withColumn("key", F.when(sound, F.concat(*hashes)))
    distinct = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("w"), F.min("vec_id").alias("least"))
    classes, _ = written(distinct, "vectors")
    given = classes.select("key", "label", "w", "v")
    meets, meets_path = written(given.mapInPandas(_cells_of, "gid long, role int, t int, key string"), "cells")
    sizes = meets.groupBy("gid").agg(F.sum(F.expr("1 - role")).alias("owners"), F.sum("role").alias("probers")).where("owners > 0 AND owners + probers > 1")
    # cells of one vector go before any vector is moved
    shared = meets.join(sizes.select("gid", *[F.ceil(F.col(c) / BLOCK).cast("int").alias(s) for c, s in (("owners", "so"), ("probers", "sp"))]), "gid")
    tasks = F.expr("""
        CASE WHEN so <= 1 AND sp <= 1 THEN array(named_struct('i', 0, 'j', 0, 'kind', 2))
             WHEN role = 0 THEN concat(transform(sequence(0, so - 1), x -> named_struct('i', least(x, block), 'j', greatest(x, block), 'kind', 0)),
                                       if(sp > 0, transform(sequence(0, sp - 1), x -> named_struct('i', block, 'j', x, 'kind', 1)), array()))
             ELSE transform(sequence(0, so - 1), x -> named_struct('i', x, 'j', block, 'kind', 1)) END""")
    shared = shared.withColumn("block", F.expr("pmod(xxhash64(key), if(role = 0, so, sp))").cast("int"))
    dealt = shared.select("gid", "role", "t", "key", "block", F.explode(tasks).alias("task")).select("gid", "role", "t", "key", "block", "task.*")
    vectors_, vectors_path = written(given.mapInPandas(_packed, "key string, label string, w long, v binary, dims int"), "packed")
    dealt = dealt.join(vectors_, "key").repartition("gid", "i", "j", "kind").sortWithinPartitions("gid", "i", "j", "kind", "key")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in by_task(frames, ["gid", "i", "j", "kind"]):
            out: tuple[list, list, list] = ([], [], [])
            if len(part) > 1 and (part["role"] == 0).any():
                _links(part.reset_index(drop=True), cosine, int(part["kind"].iloc[0]), out)
            if out[0]:
                yield pd.DataFrame({"key": np.array(out[0], object), "n": np.array(out[1], np.int64), "root": np.array(out[2], object)})

    links, _ = written(dealt.mapInPandas(compare, "key string, n long, root string"), "links")
    for path in (meets_path, vectors_path):
        drop(classes.sparkSession, path)
    degrees = links.groupBy("key").agg(F.sum("n").alias("n"))
    roots, _ = components(links.select(F.col("key").alias("u"), F.col("root").alias("v")))
    named = classes.select("key", "w", "least").join(degrees, "key", "left").join(roots.select(F.col("u").alias("key"), F.col("v").alias("root")), "key", "left")
    named = named.select("key", "least", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = named.join(ids, "root").select("key", "n_links", "component_id")
    out = rows.select("vec_id", "key").join(by_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
