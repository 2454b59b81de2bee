"""How much of one order another keeps: pairs counted while sorting, not one by one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places that are compared with each other at once before sorted blocks are merged.
BLOCK = 64


def rising_pairs(places: np.ndarray) -> int:
    """How many pairs i < j have places[i] < places[j]: blocks are counted by themselves and sorted, then sorted
    neighbours are merged, each right place counting the lesser ones on its left; n log n comparisons or so."""
    a, total = np.array(places), 0
    for s in range(0, len(a), BLOCK):
        b = a[s : s + BLOCK]
        total += int(np.triu(b[:, None] < b[None, :], 1).sum())
        b.sort()
    width = BLOCK
    while width < len(a):
        for s in range(0, len(a) - width, 2 * width):
            left, right = a[s : s + width], a[s + width : s + 2 * width]
            total += int(np.searchsorted(left, right, side="left").sum())
            a[s : s + 2 * width].sort(kind="stable")
        width *= 2
    return total


def order_counts(places: np.ndarray, streams: np.ndarray) -> tuple[int, int, int, int]:
    """Pairs, those in order, pairs of one stream, and those in order, of places listed as they should follow each other."""
    n = len(places)
    pairs, rising, within, inside = n * (n - 1) // 2, rising_pairs(places), 0, 0
    if n:
        by = np.argsort(streams, kind="stable")
        for part in np.split(places[by], np.flatnonzero(streams[by][1:] != streams[by][:-1]) + 1):
            within += len(part) * (len(part) - 1) // 2
            inside += rising_pairs(part)
    return pairs, rising, within, inside


NAMES = ("pairs", "concordant", "within", "concordant_within")


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in NAMES]))
def _order_score(lists: pa.Array) -> pa.Array:
    rows = []
    for items in lists:
        of = items.values
        place, stream = (of.field(i) for i in range(2)) if items.is_valid else (pa.array([], pa.int64()), pa.array([], pa.string()))
        codes = stream.dictionary_encode(null_encoding="encode").indices.to_numpy() if len(stream) else np.zeros(0, np.int32)
        rows.append(order_counts(place.to_numpy(zero_copy_only=False), codes))
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((),) * 4)], list(NAMES))


def order_score(items: Column) -> Column:
    """struct<pairs, concordant, within, concordant_within> of an array of (place, stream) in the order that it should have:
    how many pairs there are, how many have the earlier one at the lesser place, and the same of pairs of one stream."""
    return _order_score(F.transform(items, lambda x: F.struct(x["place"].cast("bigint").alias("place"), x["stream"].cast("string").alias("stream"))))


def tau(pairs: Column, concordant: Column) -> Column:
    """Kendall's tau as the share of pairs in order less that of the others; null without pairs."""
    return F.try_divide(2 * concordant - pairs, pairs)
