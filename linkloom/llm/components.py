"""Connected components of an edge table, by large-star and small-star steps.

Every step links each node of a neighbourhood to the neighbourhood's smallest node. Steps end when the
edges no longer change; each step's edges are stored in the shared folder. Neighbourhoods are never
gathered: the smallest neighbour is an aggregate, joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b")
    if large:  # every neighbour; the larger ones move to the smallest
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # the smaller neighbours of each node, and the node itself
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node with an edge; component is its smallest reachable node.

    ``edges`` has two comparable columns ``a`` and ``b``; loops and repeated edges are allowed, edges
    with a null end are left out.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null and a != b")
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        edges = stored(_star(_star(edges, True), False), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
