"""Exact percentiles that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, _k, _upto, _total: how often each value occurs in a group, how often it or a lesser one, and all. Equal
    values are counted before they are ordered; many different ones, as of prices in one big group, are dealt by ranges."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    return running(counts, keys, [value], {"_upto": "_k"}).withColumnRenamed("_total__upto", "_total")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, by name, the least value that so large a share of a group's values doesn't exceed."""
    return counted(rows, keys, value).groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= F.col("_total") * p, F.col(value))).alias(name) for name, p in shares.items()])


def interpolated(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, by name, the value at so large a share of the way from a group's least to its greatest value by rank,
    between the two values around that place."""
    place = lambda n, p: (n - 1) * p
    at = lambda x: F.min(F.when(F.col("_upto") > x, F.col(value)))
    ends = [c for name, p in shares.items() for c in (at(F.floor(place(F.col("_total"), p))).alias(f"{name}_low"), at(F.ceil(place(F.col("_total"), p))).alias(f"{name}_high"))]
    got = counted(rows, keys, value).groupBy(*keys).agg(F.max("_total").alias("_n"), *ends)
    part = lambda p: place(F.col("_n"), p) - F.floor(place(F.col("_n"), p))
    return got.select(*keys, *[(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * part(p)).alias(name) for name, p in shares.items()])
