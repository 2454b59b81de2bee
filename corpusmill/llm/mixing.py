"""Mixing sources to target weights (operator 6) by Pareto order sampling.

Sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1, ... and share a budget of words. A target stops at
`most` times the words its source has; what is cut off is shared out again by weight until nothing is above. With
rate = target / words of the source, every document first gets floor(rate) certain whole copies. The rest of the
target is drawn by Pareto order sampling: a document's inclusion odds are those of its share of the rest,
p = scale * size, at most 1, so that long documents, which a plain draw makes the noisiest part of a mix, are the
likelier ones; scale is such that the words expected are the rest. Its rank is its random odds u / (1 - u) divided by
its inclusion odds p / (1 - p), so that one with p = 1 comes first. Documents are taken in rank order as long as that brings the source nearer to its target,
so the sample has a fixed size in words, to within half a document.

The order is never sorted as a whole: ranks fall into bins, words are summed for each source and bin, the running sum
over a source's bins finds the bin where its target is met, and the documents of that one bin, which the ranks keep
small, are ordered in a second look. So a source that holds a third of all rows is no task of its own. Everything is
built of DataFrame functions, and u comes from an MD5 digest of doc_id, so reruns agree for rows that differ in doc_id or
text. Of exact repeats the same number is taken on average, but which of them depends on the order in which rows are read.

Null and blank texts have size 0 and are taken whole or not at all like others, for 0 words; a null source is one
source of its own. Rows without a doc_id, and rows that repeat one, draw their u by the digest of their text too, and
exact repeats by their place among the rows read as well, so that each row is drawn by itself. Texts are counted whole. Extra columns of docs
travel inside a struct and may have any name. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, small_or_not, table, uniform, word_count

#: Weights of the sources, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words wanted, as a share of all words; the most copies of a source or document.
SHARE, MOST = 1.5, 2.0
#: Rank bins of each source in the first look.
BINS = 1 << 14
#: The least inclusion probability of a draw.
LOW = 1e-6


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, n_docs, target of each source of sizes (source, size). One row
    for each source is all that is ever ordered here.

    Reshared targets have a closed form: with the sources in order of cap / weight, those before some place stop at
    their cap and the others share what is left by weight; a source stops if its cap is below its part."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    named = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = named.withColumn("weight", turn).withColumn("cap", F.lit(most) * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = weighed.withColumn("level", level)
    open_ = F.col("cap") > F.col("level") * F.col("weight")  # once one is open, all after it are
    shared = F.first(F.when(open_, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.when(shared.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), shared * F.col("weight")))
    return levels.select("source", "source_size", "n_docs", target.alias("target"))


def _bin(key: Column) -> Column:
    """Bin of a rank in 0 .. inf; ranks of 0 to 1 take half of the bins."""
    return F.floor(key / (1.0 + key) * BINS).cast("int")


def drawn_by(docs: DataFrame, text: str) -> DataFrame:
    """docs with u, a number in (0, 1) for each row: a digest of doc_id, and where that is null or repeated, of text too,
    and where both are repeated, of the row's place among the rows read. Repeats are counted before they are joined."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_again"))
    ids = small_or_not(ids)
    rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left").drop("_id")
    same = rows.where("_again").select("doc_id", digest.alias("_d")).groupBy("doc_id", "_d").agg(F.count("*").alias("n")).where("n > 1")
    same = small_or_not(same.select(F.col("doc_id").alias("_id"), "_d", F.lit(True).alias("_copy")))
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    rows = rows.join(same, rows["doc_id"].eqNullSafe(same["_id"]) & rows["_again"] & (digest == same["_d"]), "left").drop("_id", "_d")
    u = F.when(F.col("_again").isNull(), uniform(F.col("doc_id"))).when(F.col("_copy").isNull(), uniform(F.col("doc_id"), digest)).otherwise(uniform(F.col("doc_id"), digest, F.col("_at")))
    return rows.withColumn("u", u).drop("_again", "_copy", "_at")


def scales(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """s (source), scale: the factor with which words expected, the sum of size * min(1, scale * size), are the rest. sizes:
    source, size, n of documents; targets: s, rest. Sizes that reach 1 are the greatest ones, so one running sum over the
    distinct sizes of a source tells how many they are. Null where the rest takes every word."""
    joined = sizes.join(targets, sizes["source"].eqNullSafe(targets["s"])).where("size > 0")
    down = Window.partitionBy("s").orderBy(F.desc("size"))
    before, upto = down.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("s").orderBy("size")
    words, squares = (F.col("n") * F.col("size")).cast("double"), F.col("n") * F.col("size").cast("double") * F.col("size")
    told = joined.withColumn("scale", (F.col("rest") - F.coalesce(F.sum(words).over(before), F.lit(0.0))) / F.sum(squares).over(upto))
    return told.groupBy("s").agg(F.max_by(F.when(F.col("scale") * F.col("size") <= 1, F.col("scale")), F.when(F.col("scale") * F.col("size") <= 1, F.col("size"))).alias("scale"))


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc (the row of docs as a struct), size, source_size, target, copies (long) for every row of docs (doc_id,
    source, text and any other columns)."""
    rows = drawn_by(docs.select(F.struct("*").alias("doc")).select("doc", "doc.doc_id", "doc.source", "doc.text"), "text")
    sizes = rows.select("doc", "doc_id", "source", "u", word_count(F.col("text")).alias("size"))
    slim = checkpointed(sizes.select("doc_id", "source", "u", "size"))
    targets = source_targets(slim, share, most, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("sure", F.floor(rate + 1e-9)).withColumn("rest", F.greatest(F.col("target") - F.col("sure") * F.col("source_size"), F.lit(0.0)))
    targets = checkpointed(targets.select(F.col("source").alias("s"), "source_size", "target", "sure", "rest"))
    factor = scales(slim.groupBy("source", "size").agg(F.count("*").alias("n")), targets).withColumnRenamed("s", "f")
    targets = small_or_not(targets.join(factor, targets["s"].eqNullSafe(factor["f"]), "left").drop("f"))

    def ranked(rows: DataFrame) -> DataFrame:
        u = F.col("u")
        p = F.when(F.col("size") == 0, F.lit(LOW)).otherwise(F.greatest(F.least(F.coalesce(F.col("scale") * F.col("size"), F.lit(1.0)), F.lit(1.0)), F.lit(LOW)))
        joined = rows.join(targets, rows["source"].eqNullSafe(targets["s"])).drop("s")
        keyed = joined.withColumn("key", (u * (1.0 - p)) / ((1.0 - u) * p))
        return keyed.withColumn("bin", _bin(F.col("key"))).withColumn("rank", F.struct("key", "doc_id", "size"))

    first = ranked(slim)
    bins = first.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    bins = bins.withColumn("after", F.sum("words").over(Window.partitionBy("source").orderBy("bin"))).withColumn("start", F.col("after") - F.col("words"))
    # the bin in which the rest is met; a source has at most BINS rows here
    met = small_or_not(bins.where("start < rest and after >= rest").select(F.col("source").alias("m"), F.col("bin").alias("met"), "start"))
    near = first.join(met, first["source"].eqNullSafe(met["m"]) & (first["bin"] == met["met"]))
    at = F.col("start") + F.sum("size").over(Window.partitionBy("source").orderBy("rank"))
    # taken as long as half of the document or more fits; the last one taken is the source's cut
    cuts = near.withColumn("at", at).groupBy("source").agg(F.max(F.when(2 * F.col("at") - F.col("size") <= 2 * F.col("rest"), F.col("rank"))).alias("cut"))
    ends = met.join(cuts, met["m"].eqNullSafe(cuts["source"]), "left").select("m", "met", "cut")
    ends = small_or_not(ends)
    every = ranked(sizes)
    every = every.join(ends, every["source"].eqNullSafe(ends["m"]), "left")
    inside = F.col("met").isNull() | (F.col("bin") < F.col("met")) | ((F.col("bin") == F.col("met")) & F.coalesce(F.col("rank") <= F.col("cut"), F.lit(False)))
    drawn = ((F.col("rest") > 0) & inside).cast("long")
    return every.select("doc", "size", "source_size", "target", (F.col("sure") + drawn).cast("long").alias("copies"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source size, target and words taken of every document."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP6_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(text, '')) AS digest, count(*) OVER (PARTITION BY doc_id) AS times FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, (ARRAY[5.0::DOUBLE, 2.0, 1.0])[1 + (place - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS cap
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM totals)
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
), shared AS (
  SELECT *, (SELECT level FROM levels o WHERE o.cap > o.level * o.weight ORDER BY o.cap / o.weight, o.place LIMIT 1) AS part FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN part IS NULL THEN cap ELSE least(cap, part * weight) END AS target FROM shared
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS sure FROM targets
), rests AS (
  SELECT *, greatest(target - sure * source_size, 0) AS rest FROM rates
), counted AS (
  SELECT source, size, CAST(count(*) AS DOUBLE) AS n FROM sizes WHERE size > 0 GROUP BY source, size
), tried AS (
  SELECT c.source, c.size, (r.rest - coalesce(sum(n * c.size) OVER (PARTITION BY c.source ORDER BY c.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(n * c.size * c.size) OVER (PARTITION BY c.source ORDER BY c.size) AS scale
  FROM counted c JOIN rests r ON c.source IS NOT DISTINCT FROM r.source
), scales AS (
  SELECT source, max_by(scale, size) AS scale FROM tried WHERE scale * size <= 1 GROUP BY source
), odds AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.sure, r.rest,
    (CAST(('0x' || substr(md5(CASE WHEN s.doc_id IS NULL OR s.times > 1 THEN coalesce(CAST(s.doc_id AS VARCHAR), '') || '|' || s.digest ELSE CAST(s.doc_id AS VARCHAR) END), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
      / 4503599627370496::DOUBLE AS u,
    CASE WHEN s.size = 0 THEN 1e-6::DOUBLE ELSE greatest(least(coalesce(f.scale * s.size, 1), 1), 1e-6::DOUBLE) END AS p
  FROM sizes s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN scales f ON f.source IS NOT DISTINCT FROM s.source
), ranked AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY (u * (1 - p)) / ((1 - u) * p), doc_id, size) AS reach FROM odds
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (sure + CASE WHEN rest > 0 AND 2 * reach - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""
