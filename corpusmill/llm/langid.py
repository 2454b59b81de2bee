"""Language ID (operator 10): multinomial naive Bayes over hashed character n-grams.

Each text, case-folded, with every run of characters that are not letters turned into one space, yields all its
n-grams of 1 to 3 code points, hashed into `buckets` cells. Training counts the cells of each language over all
allowed documents: every partition sums its own texts, Spark adds the sums up, and the matrix that reaches the driver
has one row for each language and cell, whatever the number of documents. The log-probability matrix, whose first row is
the prior, each language's share of the documents, is broadcast with the scoring function. A batch of texts becomes one
sparse matrix of cell counts (rows, cells, counts), which numpy multiplies by the log-probabilities.

Null texts and texts without a letter are `und` with score 0 and teach nothing; rows with a null language teach
nothing. Long texts are read block by block; blocks overlap by two letters, so that the counts are those of the whole
text. Repeated rows count as often as they occur. If nothing can be learned, as from an empty table, every text is
`und`. Ties go to the language that sorts first. More than LANGUAGES different languages are an error, since the matrix
would no longer fit everywhere. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, small_batches, table, text_udf

#: Cells that the n-grams are hashed into; a power of two. Matrix: languages x BUCKETS x 4 bytes.
BUCKETS = 1 << 15
#: Languages at most: with BUCKETS, 64 MB of matrix.
LANGUAGES = 512
#: Added to each count.
ALPHA = 0.5
#: Log-likelihood differences are divided by length ** TEMPER, so that the score of a long text isn't always 1.
TEMPER = 0.5
#: Code points that are handled at a time, and entries of a sparse batch that are multiplied at a time.
BLOCK, ENTRIES = 1 << 20, 1 << 18

SPACE = 32


def _letters() -> np.ndarray:
    """Code point to letter, lower-cased; a space for all others."""
    to = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            to[c] = ord(low) if len(low) == 1 else c
    return to


LETTERS: np.ndarray | None = None


def letter_blocks(text: str) -> Iterator[np.ndarray]:
    """The letters of a text with one space in front, between words and behind, in blocks; each block after the first
    begins with the last two letters of the one before it."""
    global LETTERS
    if LETTERS is None:
        LETTERS = _letters()
    held = np.array([SPACE], np.uint32)
    for i in range(0, len(text), BLOCK):
        x = LETTERS[np.frombuffer(text[i : i + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = x == SPACE
        x = np.concatenate((held, x[~(blank & np.concatenate(([held[-1] == SPACE], blank[:-1])))]))
        if i + BLOCK >= len(text) and x[-1] != SPACE:
            x = np.append(x, np.uint32(SPACE))
        yield x
        held = x[-2:]


def cells(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The cells of a text's n-grams of 1 to 3 code points, block by block; none if it has no letter."""
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    seen = 0  # of the block's front, already counted in the block before
    for x in letter_blocks(text):
        a = x * np.uint32(0x9E3779B1)
        two = (a[:-1] ^ (x[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (x[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        one = a[seen:][x[seen:] != SPACE]
        got = np.concatenate((one >> shift, two[max(0, seen - 1) :] >> shift, three >> shift)).astype(np.int64)
        seen = min(2, len(x))
        if len(got):
            yield got


def cell_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """lang, cell, n: how often each cell occurs in the texts of a language, over all rows of docs (lang, text); the cell
    -1 counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                found = False
                for got in cells(text, buckets):
                    if lang not in sums:
                        sums[lang] = np.zeros(buckets + 1, np.int64)
                    sums[lang][1:] += np.bincount(got, minlength=buckets)
                    found = True
                if found:
                    sums[lang][0] += 1
        for lang, n in sums.items():
            at = n.nonzero()[0]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "cell": at - 1, "n": n[at]})

    small_batches()
    rows = docs.select("lang", "text").where("lang is not null and text is not null")
    return rows.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA) -> tuple[list[str], np.ndarray]:
    """The languages in order and a matrix: the logarithms of their priors, then those of their cells' probabilities. Only
    the summed counts are collected: at most buckets + 1 rows for each language."""
    counts = cell_counts(docs, buckets).cache()
    langs = sorted(r["lang"] for r in counts.where("cell = -1").select("lang").limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"the rows to learn from have more than {LANGUAGES} languages")
    rows = counts.toPandas()
    counts.unpersist()
    sums = np.zeros((buckets + 1, len(langs)))
    sums[rows["cell"].to_numpy(np.int64) + 1, rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)] = rows["n"]
    sums[1:] += alpha
    sums[0] /= max(1.0, sums[0].sum())
    sums[1:] /= sums[1:].sum(axis=0, keepdims=True)
    return langs, np.log(sums).astype(np.float32)


def sparse(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell counts of a batch of texts as a sparse matrix: rows (ascending), cells, counts."""
    rows, columns, counts = [], [], []
    for i, text in enumerate(texts):
        total: np.ndarray | None = None
        for got in cells(text or "", buckets):
            one = np.bincount(got, minlength=buckets)
            total = one if total is None else total + one
        if total is not None:
            at = total.nonzero()[0]
            rows.append(np.full(len(at), i))
            columns.append(at)
            counts.append(total[at])
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(counts)


def predict(texts: list[str | None], langs: list[str], logp: np.ndarray) -> tuple[list[str], list[float]]:
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not langs:
        return names, scores
    rows, columns, counts = sparse(texts, len(logp) - 1)
    total, n = np.zeros((len(texts), len(langs))), np.bincount(rows, counts, len(texts))
    step = max(1, ENTRIES // len(langs))
    for i in range(0, len(rows), step):  # sparse times dense, a bounded part at a time
        part = rows[i : i + step]
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        total[part[first]] += np.add.reduceat(counts[i : i + step, None] * logp[1 + columns[i : i + step]].astype(np.float64), first, axis=0)
    total += logp[0]
    share = np.exp((total - total.max(axis=1, keepdims=True)) / np.maximum(n, 1.0)[:, None] ** TEMPER)
    best, sure = total.argmax(axis=1), share.max(axis=1) / share.sum(axis=1)
    for i in np.flatnonzero(n):
        names[i], scores[i] = langs[int(best[i])], float(sure[i])
    return names, scores


def language(text: Column, model: tuple[list[str], np.ndarray], spark: SparkSession) -> Column:
    """struct<lang, score> of each text; the matrix, whose size doesn't depend on the input's, is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @text_udf("lang string, score double")
    def identify_language(texts: pa.Array) -> pa.Array:
        names, scores = predict(texts.to_pylist(), *shared.value)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return identify_language(text)


def may_learn() -> Column:
    """Rows that teach: all but a quarter, by doc_id."""
    return F.coalesce(fold(F.col("doc_id"), 4) != 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of every document, from text alone; rows with crc32(doc_id) mod 4 = 2 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(may_learn()))
    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), language(F.col("text"), model, spark).alias("got"))
    return out.select("doc_id", "held_out", F.col("got.lang").alias("lang_pred"), F.col("got.score").alias("score"))
