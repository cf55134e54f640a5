"""Connected components of a link table, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import common

#: Links that one task joins by itself; beyond that rounds of joins do.
SMALL = 250_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The roots of all links of the one partition: pointers to lesser nodes, halved until they stand still."""
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
    if not parts:
        return
    ends = np.concatenate([np.concatenate(p) for p in zip(*parts, strict=True)])
    nodes, at = np.unique(ends, return_inverse=True)
    v, u = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[v], root[u])
        new = root.copy()
        for end in (v, u):
            np.minimum.at(new, end, least)
            np.minimum.at(new, root[end], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node that is reachable.

    Up to SMALL links, a checked and bounded number, are joined by one task.  More of them alternate a large star,
    which hangs the larger neighbours of every node on its least neighbour, and a small star, which does so with
    the smaller ones, until nothing changes: a number of rounds that grows with the logarithm of the longest path.
    Both are one aggregation and one join, keyed by node; AQE splits the join where a hub holds many links.  Each
    round is written, so a lost executor costs one round.
    """
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct()
    edges = common.written(edges, "links")
    if edges.count() <= SMALL:
        out = common.written(edges.coalesce(1).mapInArrow(_joined, "node long, root long"), "roots")
        common.drop(edges)
        return out

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u <> v")
        large = large.unionByName(edges.join(least, "v").select("v", F.col("m").alias("u")).filter("u <> v")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.v", "e.u")
        before, edges = edges, common.written(small.filter("u <> v").distinct(), "links")
        common.drop(before)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
