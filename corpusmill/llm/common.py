"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What stands between words.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the path may be any that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the folder that the cluster names in
    spark.checkpoint.dir. Only a local session, whose executors are in the same process, may leave that unset."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = context.getConf().get("spark.checkpoint.dir", None)
        if root is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def small_batches() -> None:
    """Arrow batches of at most a thousand texts or 16 MB: documents may be long, and workers hold a batch twice. Spark has
    these bounds for a session only, not for a function, so they are set when a plan with such a function is built."""
    conf = SparkSession.active().conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def text_udf(return_type: str) -> Callable:
    """An Arrow function over texts."""
    small_batches()
    return F.arrow_udf(return_type)


def words(text: Column) -> Column:
    """The array of words of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words a text has, without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def uniform(*key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone: 52 bits of an MD5 digest, so that any engine can repeat it."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, bound: int) -> DataFrame:
    """Rows (doc_id, text, label) to learn from: the labelled rows that allowed accepts, at most about bound of them
    (every row if there are fewer), picked by a digest of doc_id. A doc_id that occurs more than once counts once, with the least of its texts.
    The bound keeps the fit, which happens on the driver, the same size for any input, and
    the picked ids small enough to broadcast."""
    given = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    given = given.groupBy("doc_id").agg(F.max("label").alias("label")).where(allowed)
    n = given.count()
    if n > bound:
        given = given.where(uniform(F.col("doc_id"), F.lit(label)) < bound / n)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(given), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def small_or_not(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df computed once; with a broadcast hint if it has at most so many rows, else left to a shuffled join."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= rows else kept
