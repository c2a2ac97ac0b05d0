"""Connected components of a graph of any size: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import stored


#: Up to so many edges, of two short keys each, the least neighbours of all nodes are broadcast.
BROADCAST_EDGES = 150_000


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One star operation on edges (a, b) with a > b: every node's neighbours move to its least one.

    A large star moves the greater neighbours and a small star the lesser ones and the node itself.
    The least neighbours are aggregated before their shuffle. While edges are counted ``few`` the join
    broadcasts them; beyond they are stored, so that the join is one of two plain shuffles, of which
    adaptive execution splits the part of a hub.
    """
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    root = F.least(F.min("b"), F.first("a")) if large else F.min("b")
    least = seen.groupBy(F.col("a").alias("node")).agg(root.alias("root"))
    held = least if few else stored(least, "least")
    met = seen.join(F.broadcast(held) if few else held, F.col("a") == F.col("node"))
    moved = (met.where(F.col("b") > F.col("a")) if large else met).select(F.col("b").alias("a"), F.col("root").alias("b"))
    if not large:
        moved = moved.unionByName(held.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node that it is connected with.

    Self-loops, repeated and reversed edges do no harm; edges with a null end are ignored. Each round
    is stored, and the rounds, about the logarithm of the longest path, end when nothing changes.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = stored(now.select(a.alias("a"), b.alias("b")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before, few = mark, mark[0] <= BROADCAST_EDGES
        greater = _star(now, True, few)
        now = stored(_star(greater if few else stored(greater, "large-star"), False, few), "edges")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
