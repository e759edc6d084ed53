"""Connected components by alternating large-star and small-star steps (Kiveris et al.), in DataFrame operations.

Edges are rewired towards the smallest node until every component is a star; every step is written to the shared folder, so the
lineage stays short and a lost executor costs one step. No node's neighbours are gathered: minima are aggregated
partially and joined back, those of nodes with very many edges by a broadcast of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surety.llm.common import discard, forget, materialise, written


#: A node with more edges than this, and than the edges divided by half of it, is hot; so there are at most so many.
HOT = 100_000


def _with_least(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (a, b) with m, the least neighbour of a in edges.

    A hot node's rows take m from a broadcast, whose size the definition of hot bounds, and aren't shuffled; all other
    nodes have few rows and are joined.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("edges"))
    n = edges.count()
    limit = max(HOT, 2 * n // HOT)
    if n <= limit:
        return rows.join(least.select("a", "m"), "a")
    hot = materialise(least.where(F.col("edges") > limit).select("a", F.col("m").alias("hot")), "hot-nodes")
    marked = rows.join(F.broadcast(hot), "a", "left")
    cold = marked.where("hot is null").select("a", "b").join(least.select("a", "m"), "a")
    return marked.where("hot is not null").select("a", "b", F.col("hot").alias("m")).unionByName(cold)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _with_least(both, both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return least.where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b."""
    moved = _with_least(edges, edges).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(edges.groupBy("a").agg(F.min("b").alias("b"))).distinct()


def _unsettled(edges: DataFrame) -> bool:
    """Whether some node has two parents, or a parent and children: if none has, all components are stars."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    of = ends.groupBy("node").agg(F.sum("up").alias("parents"), F.min("up").alias("least"))
    return of.where("parents > 1 or (parents = 1 and least = 0)").limit(1).count() > 0


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for the nodes of edges (a, b: longs), root being the smallest node reachable."""
    now = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while _unsettled(now):
        before, mark = now, written()
        now = materialise(_small_star(_large_star(before)), label)
        forget(edges.sparkSession, mark, now)
        discard(before)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
