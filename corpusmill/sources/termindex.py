"""An index of terms for searches by LIKE '%term%': which chunks hold which two and three characters.

Chunks are numbered where they are read, SEGMENT of them to a segment, so that no text is shuffled. A posting is (gram,
segment, numbers): the sorted numbers of a segment's chunks that hold the gram, so that the most frequent gram has one
short list a segment and no list grows with the corpus. A task writes its postings in runs of a few segments, each sorted
by gram, in small row groups, which lets Parquet skip all but the asked grams; its delta encoding stores the lists. A
search intersects the lists of all grams of its terms segment by segment and reads chunks of the segments that are left;
texts stay where they are, the lists travel to them. Terms and the phrase are verified, among the candidates alone. A
term of one character has no gram: where no term has one, all chunks are candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.frames import checkpointed

#: Chunks of a segment at most; segments of a run; segments named in a filter at most; segments whose lists, of two bytes a
#: chunk, are sent to all tasks at most, beyond which the texts of all chunks are looked at.
SEGMENT, RUN, NAMED, SENT = 2048, 8, 500, 10_000
#: Bytes of a row group of postings, about.
ROW_GROUP = 4 << 20


def gram(text: str) -> int:
    """The number of two or three characters; a first character's number is one more, so that two are unlike three."""
    codes = [ord(c) for c in text]
    return (codes[0] + 1 << 42) + (codes[1] << 21) + codes[2] if len(codes) == 3 else (codes[0] << 21) + codes[1]


def grams_of(term: str) -> list[int]:
    """The grams whose lists a chunk that holds the term is in: three characters each, two for a term of two."""
    width = min(3, len(term))
    return sorted({gram(term[i : i + width]) for i in range(len(term) - width + 1)}) if width > 1 else []


def text_grams(text: str) -> np.ndarray:
    """The distinct grams of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = (c[:-1] << 21) + c[1:]
    return np.unique(np.concatenate((two, (c[:-2] + 1 << 42) + two[1:])))


def postings_of(segments: list[tuple[int, list[tuple[int, str]]]]) -> pa.RecordBatch:
    """gram, segment, numbers, by gram, of a few segments: each with the numbers and texts of its chunks."""
    grams, places = [], []
    for at, (_, chunks) in enumerate(segments):
        for number, text in chunks:
            found = text_grams(text)
            grams.append(found)
            places.append(np.full(len(found), (at << 16) + number, np.int32))
    g, n = np.concatenate(grams), np.concatenate(places)
    order = np.lexsort((n, g))
    g, n = g[order], n[order]
    at = n >> 16
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (at[1:] != at[:-1])
    starts = np.flatnonzero(new)
    ids = np.array([segment for segment, _ in segments], np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(n)), pa.int32()), pa.array((n & 0xFFFF).astype(np.int16)))
    return pa.RecordBatch.from_pydict({"gram": pa.array(g[starts]), "segment": pa.array(ids[at[starts]]), "numbers": lists})


def task_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of a task's chunks, which come segment by segment; a segment that two tasks share has two lists."""
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("segment", "number", "norm"))))
    segments = ((segment, [row[1:] for row in of]) for segment, of in groupby(rows, key=lambda row: row[0]))
    while run := list(islice(segments, RUN)):
        yield postings_of(run)


def write_index(chunks: DataFrame, keys: list[str], text: str, path: str) -> None:
    """Indexes chunks (keys, text and any other columns, kept beside them) under path."""
    spark = chunks.sparkSession
    rows = chunks.withColumn("norm", F.coalesce(F.col(text), F.lit(""))).withColumn("_id", F.monotonically_increasing_id())
    task, nth = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    segment, number = F.shiftleft(task, 32) + F.floor(nth / SEGMENT), (nth % SEGMENT).cast("smallint")
    others = [c for c in chunks.columns if c not in (text, "norm")]
    stored = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}
    rows.select(segment.alias("segment"), number.alias("number"), *others, "norm").write.options(**stored).parquet(f"{path}/chunks")
    kept = spark.read.parquet(f"{path}/chunks").select("segment", "number", "norm")
    postings = kept.mapInArrow(task_postings, "gram long, segment long, numbers array<smallint>")
    postings.write.options(**stored).option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")


class TermIndex:
    """A written index; keys: the columns that name a chunk, in the order of a cap."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.keys = keys
        self.chunks = spark.read.parquet(f"{path}/chunks")
        self.postings = spark.read.schema("gram long, segment long, numbers array<smallint>").parquet(f"{path}/postings")

    def holders(self, grams: list[int]) -> DataFrame:
        """segment, numbers: the chunks that are in the lists of all these grams."""
        lists = self.postings.where(F.col("gram").isin(grams)).repartition("segment")
        whole = lists.groupBy("segment", "gram").agg(F.flatten(F.collect_list("numbers")).alias("numbers"))
        # as many lists as grams at most, each of a segment's size at most
        by_segment = whole.groupBy("segment").agg(F.collect_list("numbers").alias("lists")).where(F.size("lists") == len(grams))
        both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
        return by_segment.select("segment", both.alias("numbers")).where(F.size("numbers") > 0)

    def candidates(self, grams: list[int]) -> DataFrame:
        """Chunks, with all their columns, that the lists of these grams leave over; only their segments are read."""
        if not grams:
            return self.chunks
        left = checkpointed(self.holders(grams))
        some = [r["segment"] for r in left.select("segment").limit(NAMED + 1).collect()]
        chunks = self.chunks.where(F.col("segment").isin(some)) if len(some) <= NAMED else self.chunks
        if len(some) > NAMED and left.count() > SENT:
            return chunks
        return chunks.join(F.broadcast(left), "segment").where(F.array_contains("numbers", F.col("number"))).drop("numbers")

    def search(self, terms: list[str], where: Column | None = None, cap: int | None = None, per: str | None = None, by: list[Column] | None = None) -> DataFrame:
        """Chunks that hold all terms (as they stand, in the indexed form of the text) and that where accepts. cap: of
        them, only so many of the least keys, the same ones each time. per: of those, one for each value of this column,
        the first by `by`, then by key."""
        grams = sorted({g for t in terms for g in grams_of(t)})
        rows = self.candidates(grams)
        for term in terms:
            rows = rows.where(F.contains(F.col("norm"), F.lit(term)))
        if where is not None:
            rows = rows.where(where)
        if cap is not None:
            rows = rows.orderBy(*self.keys).limit(cap)
        if per is not None:
            best = F.row_number().over(Window.partitionBy(per).orderBy(*(by or []), *self.keys))
            rows = rows.withColumn("_n", best).where("_n = 1").drop("_n")
        return rows.drop("segment", "number")
