"""Numbers and running sums along an order, where one key may have most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpointed, small_or_not

#: Rows, of all groups together, up to which a group is one window.
FEW = 200_000


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with, for each name of sums, the sum of its column over the group's rows up to here in order, this one
    included, and under _total_ and the name over all of them. order tells a group's rows apart. More than FEW rows are
    dealt by ranges of (keys, order): each range sums up by itself and is carried on by the sums of the group's ranges
    before it, of which there are as many as partitions at most."""
    kept = checkpointed(rows)
    n = kept.count()
    group = keys or [F.lit(0)]
    of = Window.partitionBy(*group)
    total = {name: f"_total_{name}" for name in sums}
    if n <= FEW:
        along = of.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return kept.select("*", *[F.sum(c).over(along).alias(name) for name, c in sums.items()], *[F.sum(c).over(of).alias(total[name]) for name, c in sums.items()])
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // max(FEW, 1000)))
    dealt = checkpointed(kept.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    shares = dealt.groupBy(*keys, "_part").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    before = of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [x for name in sums for x in (F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_before_{name}"), F.sum(name).over(of).alias(total[name]))]
    named = {c: f"_of_{i}" for i, c in enumerate([*keys, "_part"])}
    told = small_or_not(shares.select(*[F.col(c).alias(x) for c, x in named.items()], *carried))
    same = F.lit(True)
    for c, x in named.items():
        same = same & F.col(c).eqNullSafe(F.col(x))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = dealt.join(told, same)
    runs = [(F.col(f"_before_{name}") + F.sum(c).over(inside)).alias(name) for name, c in sums.items()]
    return joined.select(*rows.columns, *runs, *total.values())
