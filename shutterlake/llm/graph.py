"""Connected components of a distributed edge list by randomized contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """node, component (its least node) of every node of an edge list of longs.

    In each round every node goes over to the node of least random priority
    among itself and its neighbours, and edges are drawn between the new nodes,
    until none is left. A path shrinks by a constant factor a round, whatever
    the order of its ids, so the rounds are logarithmic in the longest one.
    Repeated edges and loops are allowed; an empty list gives an empty result.
    """
    spark = edges.sparkSession
    links = settled(edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    moves: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), c).alias("r"), c.alias("id"))  # noqa: B023, E731
        best = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("best"))
        move = settled(best.select(F.col("a").alias("old"), F.least(rank(F.col("a")), F.col("best"))["id"].alias("new")), "move")
        moves.append(move)
        left = links.join(move, links["a"] == move["old"]).select(F.col("new").alias("a"), "b")
        links = left.join(move, left["b"] == move["old"]).select("a", F.col("new").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = settled(links, "edges")
    at = nodes.withColumn("at", F.col("node"))
    for move in moves:
        at = at.join(move, at["at"] == move["old"], "left").select("node", F.coalesce("new", "at").alias("at"))
    if not moves:
        return spark.createDataFrame([], "node long, component long")
    at = settled(at, "labels")
    least = at.groupBy("at").agg(F.min("node").alias("component"))
    return at.join(least, "at").select("node", "component")
