"""Writers: exports, day overwrites, keyed merges."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import file_system, put_in_place


def safe_cell(value: Column) -> Column:
    """A cell that a spreadsheet takes as text: what would begin a formula is quoted."""
    text = value.cast("string")
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def export_csv(df: DataFrame, path: str, most: int, order: list[Column]) -> bool:
    """Writes at most so many rows, in order, as CSV with guarded cells; returns whether rows were left out. The limit
    is the export's feature, not a bound on the work."""
    rows = df.orderBy(*order).limit(most + 1)
    truncated = rows.count() > most
    rows.limit(most).select(*[safe_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").option("header", "true").csv(path)
    return truncated


def write_result(df: DataFrame, path: str, most_bytes: int = 5_000_000) -> int:
    """Writes a small result as one JSON file and returns its size. It is written beside path and takes its name when whole;
    readers see the one of before until then. A result of more bytes is an error, and path stays as it was."""
    spark = df.sparkSession
    fresh = f"{path}-new-{uuid.uuid4().hex}"
    df.coalesce(1).write.json(fresh)
    files, where = file_system(spark, fresh)
    size = files.getContentSummary(where).getLength()
    if size > most_bytes:
        files.delete(where, True)
        raise ValueError(f"a result of {size} bytes, of at most {most_bytes}")
    if not put_in_place(spark, fresh, path):
        raise OSError(f"{path} could not be replaced")
    return size


def overwrite_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Replaces the partitions of the days that df has, and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same keys; the last writer wins."""
    tagged = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    return tagged.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_age"))).where("_n = 1").drop("_age", "_n")


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that fresh names give way to fresh; other parents keep theirs."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str], added: list[str], greatest: list[str]) -> DataFrame:
    """Adds some columns and takes the greatest of others by key; null keys are one key."""
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in added], *[F.max(c).alias(c) for c in greatest])


def union_arrays(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sorted union of an array column by key."""
    both = old.select(*keys, column).unionByName(new.select(*keys, column))
    return both.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias(column))


def without_tombstones(df: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no tombstone has deleted, as after a restore from backup."""
    return df.join(tombstones.select(*keys).distinct(), keys, "left_anti")
