"""Directed graphs as edge tables (node, ancestor): layers by peeling, and what reaches a node, a front at a time.

Each round joins only the front of the round before with the edges, by ancestor, and is cut by a checkpoint. In layers a
small front is sent to the edges, and a round with a large one leaves the edges that it has used behind. Nothing is
collected but counts; the number of rounds is the length of the longest path, not the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import checkpointed

#: Nodes of a front that is sent to all edges at most.
SMALL = 50_000


def simple(edges: DataFrame) -> DataFrame:
    """Each edge once, without loops and nulls."""
    return checkpointed(edges.where("node is not null and ancestor is not null and node <> ancestor").select("node", "ancestor").distinct())


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, layer, cyclic: of nodes that depend on nothing 0, of others one more than the deepest that they depend on. On a
    cycle or behind one (cyclic) a node has no such number; it gets one more than the deepest numbered one that it
    depends on itself, or 0."""
    edges = simple(edges)
    degree = edges.groupBy("node").agg(F.count("*").alias("needs"))
    every = checkpointed(nodes.select("node").distinct().join(degree, "node", "left").select("node", F.coalesce("needs", F.lit(0)).alias("needs")))
    done = front = checkpointed(every.where("needs = 0").select("node", F.lit(0).alias("layer")))
    # an edge knows what its node needs, so that no round asks all nodes
    ahead = checkpointed(edges.join(every.where("needs > 0"), "node").select("ancestor", "node", "needs"))
    waiting = None  # node, needs, met: nodes that some numbered ones lead to, but not all
    size = front.count()
    for depth in range(1, every.count() + 1):
        used = front.select(F.col("node").alias("ancestor"))
        if size <= SMALL:
            hit = ahead.join(F.broadcast(used), "ancestor")
        else:
            told = checkpointed(ahead.join(used.withColumn("hit", F.lit(True)), "ancestor", "left"))
            hit, ahead = told.where("hit"), told.where("hit is null").drop("hit")
        met = hit.groupBy("node").agg(F.max("needs").alias("needs"), F.count("*").alias("met"))
        if waiting is not None:
            met = waiting.unionByName(met).groupBy("node").agg(F.max("needs").alias("needs"), F.sum("met").alias("met"))
        met = checkpointed(met)
        front = met.where("met = needs").select("node", F.lit(depth).alias("layer"))
        size = front.count()
        if not size:
            break
        waiting = met.where("met < needs")
        done = done.unionByName(front)
        if depth % 20 == 0:  # else a deep graph's plan would be as long as its longest path
            done = checkpointed(done)
    done = checkpointed(done)
    left = every.join(done, "node", "left_anti").select("node")
    above = edges.join(left, "node", "left_semi").join(done.select(F.col("node").alias("ancestor"), "layer"), "ancestor").groupBy("node").agg(F.max(F.col("layer") + 1).alias("layer"))
    rest = left.join(above, "node", "left").select("node", F.coalesce("layer", F.lit(0)).alias("layer"), F.lit(True).alias("cyclic"))
    return done.withColumn("cyclic", F.lit(False)).unionByName(rest)


def reached(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """node, low, high: the least and the greatest of the sources (node) that a node depends on, directly or not. Both are a
    node itself if it depends on no source but, by a cycle, on itself."""
    edges = simple(edges)
    seed = sources.select("node", F.col("node").alias("low"), F.col("node").alias("high"))
    known, front = None, checkpointed(seed)
    while True:
        on = front.withColumnRenamed("node", "ancestor").join(edges, "ancestor").groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        if known is None:
            now = on.withColumn("new", F.lit(True))
        else:
            was = known.select("node", F.col("low").alias("l"), F.col("high").alias("h"))
            both = was.join(on, "node", "full")
            new = F.col("low").isNotNull() & (F.col("l").isNull() | (F.col("low") < F.col("l")) | (F.col("high") > F.col("h")))
            now = both.select("node", F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high"), F.coalesce(new, F.lit(False)).alias("new"))
        known = checkpointed(now)
        front = known.where("new").select("node", "low", "high")
        if front.isEmpty():
            return known.select("node", "low", "high")
