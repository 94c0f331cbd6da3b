"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

A node's least neighbour is a partial aggregate.  Where edges meet it, few edges (MAX_BROADCAST, by count) take the least neighbours as a
broadcast; beyond that, only nodes with more than 1 / HUBS of all edges are hubs.  There are at most 2 x HUBS of these, whatever the input,
so their least neighbours are broadcast and no task gathers a hub's edges; the others' edges are shuffled.  Each round is a table in the
shared folder, until every edge leads to a root; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop, written

FILE_ROWS, MAX_BROADCAST, HUBS = 500_000, 100_000, 2000


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``edges`` with the column m of ``least`` (u, m, degree)."""
    if n <= MAX_BROADCAST:
        return edges.join(F.broadcast(least.drop("degree")), "u")
    hub = F.col("degree") > n // HUBS
    hubs = F.broadcast(least.where(hub).drop("degree"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(~hub).drop("degree"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One round; the n edges (u, v) have u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        out = _with_least(both, least, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        out = _with_least(edges, least, n).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Is every v a root and every u under one v alone?"""
    inner = edges.select("v").distinct().join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    return not inner.limit(1).count() and not edges.groupBy("u").count().where("count > 1").limit(1).count()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(u, v) of each node u that isn't the least of its component, with the least node v; and the table's path.

    ``edges`` has columns u and v of one orderable type, in any order and with repeats; loops and nulls are left out.
    """
    spark = edges.sparkSession
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = written(edges, "edges", narrow=True)
    while not _stars(now):
        n = now.count()  # a round never has more edges than the one before
        files = -(-n // FILE_ROWS)
        half, half_path = written(_star(now, True, n), "edges", narrow=True, files=files)
        new, new_path = written(_star(half, False, n), "edges", narrow=True, files=files)
        for p in (path, half_path):
            drop(spark, p)
        now, path = new, new_path
    return now, path
