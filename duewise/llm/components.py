"""Connected components of a link table, as Spark jobs over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duewise.llm.common import Workspace


def _nearest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """node, component: the least node reachable by ``links`` (a, b), for every node of a link to another node.

    Alternating large-star and small-star rounds: every round hangs each node's neighbours on the least of them,
    so the edges never become more and the rounds are about the logarithm of the longest path. A node with a
    third of all links is one more key of an aggregation that combines before its shuffle, and of a join that
    adaptive execution splits. Each round is a table in the shared folder.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = ws.stage(links.select(a.alias("u"), b.alias("v")).where("u != v").distinct(), f"{name}-0")
    state, turn = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state, turn = now, turn + 1
        # Large star: the greater neighbours of a node go to the least of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _nearest(both).select("u", F.least("u", "m").alias("m"))
        large = ws.stage(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), f"{name}-{turn}-large")
        # Small star: a node and its lesser neighbours go to the least of them.
        small = large.join(_nearest(large), "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        edges = ws.stage(small, f"{name}-{turn}")
        ws.drop(f"{name}-{turn}-large", f"{name}-{turn - 1}")
