"""Connected components by alternating stars (large, then small)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Links that one task folds, round by round, without a shuffle.
FEW = 200_000


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (least node of its component) for the nodes that have a link (a, b). Links fold into stars around
    least nodes; it ends when a round changes nothing. No more than FEW links, as they are counted, are folded in one
    task: a shuffle for each step of each round would write more files than they have rows."""
    edges, before = checkpointed(links.where("a <> b").select("a", "b").distinct()), None
    n = edges.count()
    if not n:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    together = (lambda df: df.coalesce(1)) if n <= FEW else (lambda df: df)
    edges = together(edges)
    for _ in range(rounds):
        a, b = F.col("a"), F.col("b")
        both = edges.select(F.inline(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = together(large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)).where("a <> b").distinct()
        edges = together(checkpointed(small))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
