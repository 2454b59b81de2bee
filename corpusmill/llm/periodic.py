"""Periodic run detection (operator 13).

A run is a stretch of words that repeats its first q words at least four times (six words at least), as long as it can
be. A word of a run stands in it four times or more. So a segment, at first the whole text, is split at words that it
holds less often, its parts again by their own counts, until nothing splits; natural prose falls apart in a few rounds.
What survives is scanned lag by lag: of a run of 4q words, four stand on places divisible by q, so that lag q looks at
those places alone and compares onwards only where they agree; a segment of m words takes about m log m comparisons.

Null and empty texts have no words and no runs. Long texts are handled whole, in memory proportional to their words.
Repeated rows come out alike. Runs may overlap; all are reported, in order of start, then period. Empty tables give no
rows; other columns than doc_id and text are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_udf

#: A run repeats its period so often, and has so many words, at least.
TIMES, WORDS = 4, 6
#: Rounds of splitting. Prose needs three or four; a text made to need more is scanned in larger segments, which
#: takes longer and finds the same runs.
ROUNDS = 64


def segments(alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where alive is true, of WORDS words or more."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], alive.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= WORDS
    return starts[long], ends[long]


def surviving(codes: np.ndarray) -> list[tuple[int, int]]:
    """The segments that splitting at rare words leaves. A segment without a rare word is finished; only the parts of
    the others are counted again."""
    done: list[tuple[int, int]] = []
    starts, ends = segments(np.bincount(codes)[codes] >= TIMES)
    for _ in range(ROUNDS):
        if not len(starts):
            return done
        lengths = ends - starts
        owner = np.repeat(np.arange(len(starts)), lengths)
        first = np.cumsum(lengths) - lengths
        places = np.arange(len(owner)) - first[owner] + starts[owner]
        _, key, n = np.unique(owner * (int(codes.max()) + 1) + codes[places], return_inverse=True, return_counts=True)
        rare = n[key] < TIMES
        split = np.bincount(owner[rare], minlength=len(starts)) > 0
        done += zip(starts[~split].tolist(), ends[~split].tolist())
        inside = split[owner]
        alive = np.zeros(len(codes) + 1, bool)
        alive[places[inside & ~rare]] = True
        # neighbouring segments never touch: a rare word lies between them
        starts, ends = segments(alive)
    return done + list(zip(starts.tolist(), ends.tolist()))


def agrees(w: np.ndarray, x: int, q: int, step: int) -> int:
    """How many words from x on, going by step, equal the word q further on; compared in growing blocks."""
    n, block, room = 0, 64, len(w) - q - x if step > 0 else x + 1
    while n < room:
        size = min(block, room - n)
        a = x + n if step > 0 else x - n - size + 1
        differs = np.flatnonzero(w[a : a + size] != w[a + q : a + q + size])
        if len(differs):
            return n + int(differs[0] if step > 0 else size - 1 - differs[-1])
        n, block = n + size, block * 2
    return n


def scan(w: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of every run of a segment, period by period."""
    m = len(w)
    four = w[: m - 3].astype(np.int64)  # four words as one number; only a filter, so that equal numbers may differ
    for k in range(1, 4):
        four = four * np.int64(1_000_003) + w[k : m - 3 + k]
    cover, by = np.zeros(m, np.int64), np.ones(m, np.int64)  # the furthest end of a found run here, and its period
    for q in range(1, m // TIMES + 1):
        grid = (w if q < 4 else four)[::q]
        same = grid[1:] == grid[:-1]
        x = np.flatnonzero(same[1:] & same[:-1]) * q
        if not len(x):
            continue
        # Inside a run of smaller period, three periods q or a multiple of that period are no run of their own.
        end = cover[x]
        x = x[(end < x + 3 * q) & ((q % by[x] != 0) | (x + q >= end))]
        seen = 0
        for i in x.tolist():
            if i < seen:
                continue
            right = i + agrees(w, i, q, 1)
            start, seen = (i - agrees(w, i - 1, q, -1) if i else 0), right + 1
            stop = right + q
            if stop - start >= max(WORDS, TIMES * q) and cover[start] < stop:
                yield start, stop - start, q
                further = np.flatnonzero(cover[start:stop] < stop) + start
                cover[further], by[further] = stop, q


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of words, by start, then period."""
    numbers: dict = defaultdict(count().__next__)
    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    if len(codes) < WORDS:
        return []
    return sorted((a + s, n, q) for a, b in surviving(codes) for s, n, q in scan(codes[a:b]))


def collapsed_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return words if keep.all() else [words[i] for i in np.flatnonzero(keep).tolist()]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic(text: Column) -> Column:
    """struct<runs, collapsed>: the runs of each text, and its words without repeats, joined by one space."""

    @text_udf("struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")
    def find_runs(texts: pa.Array) -> pa.Array:
        ends, found, short = [0], [], []
        for text in texts:
            words = (text.as_py() or "").encode().split()  # bytes split at ASCII white space alone
            runs = runs_of(words)
            found += runs
            ends.append(len(found))
            short.append(b" ".join(collapsed_words(words, runs)))
        columns = np.array(found, np.int64).reshape(-1, 3).T
        rows = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(RUN))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
        return pa.StructArray.from_arrays([lists, pa.array(short, pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    return find_runs(text)


def document_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length, period), collapsed (string); other columns of docs are not read."""
    return docs.select("doc_id", periodic(F.col("text")).alias("found")).select("doc_id", "found.*")


def with_copies(text: Column, h: Column) -> Column:
    """The text of the query's contract: if h is divisible by ten, a tail of the words goes round in itself."""

    @text_udf("string")
    def go_round(texts: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for text, h in zip(texts.to_pylist(), marks.to_pylist()):
            words = text.encode().split() if text and h is not None and h % 10 == 0 else []
            if n := len(words):
                g = h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words[a:] = [words[a + i % p] for i in range(n - a)]
                text = b" ".join(words).decode()
            out.append(text)
        return pa.array(out, pa.string())

    return go_round(text, h)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them made to go round; the longest run, and digests of runs and kept words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = document_runs(docs.withColumn("text", with_copies(F.col("text"), h)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("n"), (-r.start).alias("s"), (-r.period).alias("p"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    lines = F.array_join(F.transform(line, lambda r: F.concat(r, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.n div -best.p").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
