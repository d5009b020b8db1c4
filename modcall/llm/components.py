"""Connected components of a link table by alternating large-star and small-star steps."""

from pyspark.sql import functions as F

from .common import materialize


def _star(edges, large: bool):
    """One step. large: a node's larger neighbours move to its smallest; small: the smaller ones and itself do."""
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b"), F.least("a", "b"))
    both = both.toDF("u", "v")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    if large:
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = both.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return moved.where("a <> b").distinct()


def _state(edges):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges):
    """Rows (node, component): the smallest node reachable, for every node of a link between two nodes.

    edges has two long columns; links have no direction, repeats and loops are harmless. The smallest
    neighbour is found by a partially aggregated minimum and joined back, which Spark splits for a hub.
    """
    edges = materialize(edges.toDF("a", "b").where("a <> b").distinct())
    before = None
    while True:
        now = _state(edges)
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        before = now
        edges = materialize(_star(_star(edges, True), False))
