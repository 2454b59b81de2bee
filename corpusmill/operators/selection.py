"""Choosing what to answer from: ranking with recency, the selection policy, diversity with quotas, numbering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.registry import query
from corpusmill.sources.tables import load

from .retrieval import nearest

#: Half-life of recency in days; above which factor a document is fresh, below which it is stale enough to be cut off.
HALF_LIFE, FRESH, STALE = 90.0, 0.5, 0.1
#: Width of a relevance band and what is added before it is cut.
BAND, SLACK = 0.10, 0.03
#: Candidates of a question; documents, characters and old documents chosen at most; documents before the floor holds.
NEAREST, MOST, CHARS, OLD, OLD_DAYS, LEAST, FLOOR = 60, 12, 9000, 3, 365, 3, 0.02
#: Diversity: weight of relevance, documents chosen, and of one source or month at most once LEAST are in.
WEIGHT, PICKS, PER_SOURCE, PER_MONTH = 0.7, 10, 2, 3

CANDIDATES = f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id AS probe, v AS pv FROM e WHERE vec_id % 20 = 0),
near AS (SELECT * FROM (SELECT probe, vec_id, round(1 - list_cosine_similarity(pv, v), 9) AS distance, row_number() OVER (PARTITION BY probe ORDER BY round(1 - list_cosine_similarity(pv, v), 9), vec_id) AS rn FROM p, e WHERE vec_id <> probe) WHERE rn <= {NEAREST}),
told AS (SELECT probe, doc_id, source, round(1 - distance, 4) AS fused, n_chars, CASE WHEN contains(lower(text), 'the in') THEN 2 WHEN contains(lower(text), 'the') AND contains(lower(text), 'and') THEN 1 ELSE 0 END AS tier, CAST(doc_id * 37 % 700 AS INTEGER) AS age
  FROM near JOIN documents ON doc_id = vec_id),
scored AS (SELECT *, pow(0.5::DOUBLE, age / {HALF_LIFE}) AS recency, CAST(trunc((fused + {SLACK}) / {BAND}) AS INTEGER) AS band FROM told),
ranked AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY tier DESC, band DESC, recency DESC, fused DESC, doc_id DESC) AS place FROM scored)
"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """probe, doc_id, source, fused, n_chars, tier, age (days; a digest of the id stands for the date), recency, band and
    place of the nearest documents of each probe, best first: tier, band of relevance, recency, score, id."""
    vectors = load(spark, d, "embeddings")
    near = nearest(vectors.where("vec_id % 20 = 0"), vectors, NEAREST).select("probe", F.col("vec_id").alias("doc_id"), F.round(1 - F.col("distance"), 4).alias("fused"))
    t = F.lower("text")
    tier = F.when(t.contains("the in"), 2).when(t.contains("the") & t.contains("and"), 1).otherwise(0)
    docs = load(spark, d, "documents").select("doc_id", "source", "n_chars", tier.alias("tier"), (F.col("doc_id") * 37 % 700).cast("int").alias("age"))
    rows = near.join(docs, "doc_id")
    rows = rows.withColumn("recency", F.pow(F.lit(0.5), F.col("age") / HALF_LIFE)).withColumn("band", ((F.col("fused") + SLACK) / BAND).cast("int"))
    order = [F.desc("tier"), F.desc("band"), F.desc("recency"), F.desc("fused"), F.desc("doc_id")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("probe").orderBy(*order)))


@query(CANDIDATES + "SELECT probe, doc_id, tier, band, round(recency, 6) AS recency, place FROM ranked")
def selection_ranking(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("probe", "doc_id", "tier", "band", F.round("recency", 6).alias("recency"), F.col("place").cast("long").alias("place"))


def relevant(tier: Column, fused: Column) -> Column:
    return (tier >= 1) | (fused >= FLOOR)


def policy(rows: DataFrame) -> DataFrame:
    """probe, doc_id, taken (characters), kept (passages) and number of the documents chosen from candidates' rows.

    Each probe's at most NEAREST rows are folded in order of place inside one expression. Very old ones are cut off if two
    fresh and relevant ones are there; once LEAST are in, irrelevant ones are passed over, and old ones beyond OLD; a
    passage that the budget of characters doesn't hold is skipped, not the end."""
    passages = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.greatest(F.lit(0), F.least(F.lit(600), F.col("n_chars") - 520 * i)).cast("long"))
    row = F.struct("place", "doc_id", "tier", "fused", "recency", (F.col("age") > OLD_DAYS).alias("old"), passages.alias("passages"))
    lists = rows.groupBy("probe").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.count_if((F.col("recency") >= FRESH) & relevant(F.col("tier"), F.col("fused"))).alias("fresh"))
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("old"), F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<doc_id:bigint,number:int,kept:int,taken:bigint>>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        enough = s["n"] >= LEAST
        passed = (s["n"] >= MOST) | ((F.col("fresh") >= 2) & (r["recency"] < STALE)) | (enough & ~relevant(r["tier"], r["fused"])) | (enough & r["old"] & (s["old"] >= OLD))
        start = F.struct(s["total"].alias("total"), F.lit(0).alias("kept"))
        fits = lambda x: (x["size"] > 0) & (x["total"] + x["size"] <= CHARS)
        packed = F.aggregate(
            r["passages"], start,
            lambda a, size: F.transform(F.array(F.struct(a["total"].alias("total"), a["kept"].alias("kept"), size.alias("size"))), lambda x: F.struct(
                F.when(fits(x), x["total"] + x["size"]).otherwise(x["total"]).alias("total"), F.when(fits(x), x["kept"] + 1).otherwise(x["kept"]).alias("kept")
            ))[0],
        )

        def taken(k: Column) -> Column:
            new = F.struct(r["doc_id"].alias("doc_id"), (s["n"] + 1).alias("number"), k["kept"].alias("kept"), (k["total"] - s["total"]).alias("taken"))
            after = F.struct((s["n"] + 1).alias("n"), (s["old"] + r["old"].cast("int")).alias("old"), k["total"].alias("total"), F.concat(s["out"], F.array(new)).alias("out"))
            return F.when(passed | (k["kept"] == 0), s).otherwise(after)

        return F.transform(F.array(packed), taken)[0]

    return lists.select("probe", F.explode(F.aggregate("rows", empty, step)["out"]).alias("x")).select("probe", "x.*")


FOLDED = CANDIDATES + f"""
, fresh AS (SELECT probe, count(*) FILTER (recency >= {FRESH} AND (tier >= 1 OR fused >= {FLOOR})) AS fresh FROM ranked GROUP BY probe),
sized AS (SELECT r.*, f.fresh, greatest(0, least(600, n_chars)) AS s1, greatest(0, least(600, n_chars - 520)) AS s2, greatest(0, least(600, n_chars - 1040)) AS s3 FROM ranked r JOIN fresh f USING (probe)),
fold AS (
  SELECT probe, CAST(0 AS BIGINT) AS place, 0 AS n, 0 AS old, CAST(0 AS BIGINT) AS total, CAST(NULL AS BIGINT) AS doc_id, 0 AS kept, CAST(0 AS BIGINT) AS taken FROM fresh
  UNION ALL
  SELECT probe, place, n + ok, old + CASE WHEN ok = 1 AND age > {OLD_DAYS} THEN 1 ELSE 0 END, CASE WHEN ok = 1 THEN t3 ELSE total END, CASE WHEN ok = 1 THEN doc_id END, CASE WHEN ok = 1 THEN k ELSE 0 END, CASE WHEN ok = 1 THEN t3 - total ELSE 0 END FROM (
    SELECT *, CASE WHEN k = 0 OR n >= {MOST} OR (fresh >= 2 AND recency < {STALE}) OR (n >= {LEAST} AND tier < 1 AND fused < {FLOOR}) OR (n >= {LEAST} AND age > {OLD_DAYS} AND old >= {OLD}) THEN 0 ELSE 1 END AS ok FROM (
      SELECT *, t2 + CASE WHEN s3 > 0 AND t2 + s3 <= {CHARS} THEN s3 ELSE 0 END AS t3, k2 + CASE WHEN s3 > 0 AND t2 + s3 <= {CHARS} THEN 1 ELSE 0 END AS k FROM (
        SELECT *, t1 + CASE WHEN s2 > 0 AND t1 + s2 <= {CHARS} THEN s2 ELSE 0 END AS t2, k1 + CASE WHEN s2 > 0 AND t1 + s2 <= {CHARS} THEN 1 ELSE 0 END AS k2 FROM (
          SELECT s.*, f.n, f.old, f.total, f.total + CASE WHEN s1 > 0 AND f.total + s1 <= {CHARS} THEN s1 ELSE 0 END AS t1, CASE WHEN s1 > 0 AND f.total + s1 <= {CHARS} THEN 1 ELSE 0 END AS k1
          FROM fold f JOIN sized s ON s.probe = f.probe AND s.place = f.place + 1)))))
"""


@query(FOLDED + "SELECT probe, doc_id, CAST(n AS INTEGER) AS number, CAST(kept AS INTEGER) AS kept, CAST(taken AS BIGINT) AS taken FROM fold WHERE doc_id IS NOT NULL")
def select_reports(spark: SparkSession, d: str) -> DataFrame:
    """The selection policy for each probe."""
    return policy(candidates(spark, d))


@query(FOLDED + """
SELECT f.probe, f.doc_id, CAST(f.n AS INTEGER) AS number, r.age = min(r.age) OVER (PARTITION BY f.probe) AS is_latest FROM fold f JOIN ranked r ON r.probe = f.probe AND r.doc_id = f.doc_id WHERE f.doc_id IS NOT NULL
""")
def context_numbering(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents numbered in order, those of the newest date marked."""
    rows = candidates(spark, d)
    chosen = policy(rows).join(rows.select("probe", "doc_id", "age"), ["probe", "doc_id"])
    return chosen.select("probe", "doc_id", "number", (F.col("age") == F.min("age").over(Window.partitionBy("probe"))).alias("is_latest"))


@query(FOLDED + """
SELECT r.probe, r.doc_id, row_number() OVER (PARTITION BY r.probe ORDER BY c.doc_id IS NULL, r.fused DESC, r.doc_id) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY probe, taken ORDER BY fused DESC, doc_id) AS head FROM (SELECT r.*, c.doc_id IS NOT NULL AS taken FROM ranked r LEFT JOIN fold c ON c.probe = r.probe AND c.doc_id = r.doc_id)) r
LEFT JOIN (SELECT probe, doc_id FROM fold WHERE doc_id IS NOT NULL) c ON c.probe = r.probe AND c.doc_id = r.doc_id
""")
def rerank_head_first(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with those that the policy admits moved to the front, where a second scorer will look; both parts keep
    their order by score."""
    rows = candidates(spark, d)
    admitted = policy(rows).select("probe", "doc_id", F.lit(True).alias("in"))
    order = Window.partitionBy("probe").orderBy(F.col("in").isNull(), F.desc("fused"), "doc_id")
    return rows.join(admitted, ["probe", "doc_id"], "left").select("probe", "doc_id", F.row_number().over(order).cast("long").alias("place"))


@query(FOLDED + "SELECT DISTINCT f.doc_id, round(list_sum(e.v), 6) AS total FROM fold f JOIN e ON e.vec_id = f.doc_id WHERE f.doc_id IS NOT NULL")
def late_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors read only for documents that were chosen."""
    ids = policy(candidates(spark, d)).select(F.col("doc_id").alias("vec_id")).distinct()
    vectors = load(spark, d, "embeddings").join(ids, "vec_id", "left_semi")
    return vectors.select(F.col("vec_id").alias("doc_id"), F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def diverse(rows: list[dict], weight: float = WEIGHT, picks: int = PICKS, per_source: int = PER_SOURCE, per_month: int = PER_MONTH) -> list[int]:
    """Places, in rows sorted by rank, of a greedy choice: weight * (1 - place / n) less (1 - weight) * the greatest
    likeness to one chosen. A source or month that has its share waits once LEAST are in; what waited is let in by rank if
    room is left. Rows: embedding, source, month (either may be None)."""
    vectors = np.array([r["embedding"] for r in rows], float)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    rank = 1.0 - np.arange(len(rows)) / len(rows)
    nearness, chosen, left = np.zeros(len(rows)), [], list(range(len(rows)))
    used: dict[tuple[str, object], int] = {}
    quotas = [("source", per_source), ("month", per_month)]
    while left and len(chosen) < picks:
        full = lambda i: len(chosen) >= LEAST and any(rows[i][k] is not None and used.get((k, rows[i][k]), 0) >= most for k, most in quotas)
        free = [i for i in left if not full(i)]
        if not free:
            break
        best = max(free, key=lambda i: (weight * rank[i] - (1 - weight) * nearness[i], -i))
        like = unit @ unit[best]
        nearness = like if not chosen else np.maximum(nearness, like)
        chosen.append(best)
        left.remove(best)
        for k, _ in quotas:
            used[k, rows[best][k]] = used.get((k, rows[best][k]), 0) + 1
    return chosen + left[: picks - len(chosen)]


DIVERSE = CANDIDATES + f"""
, items AS (SELECT r.probe, r.place, r.doc_id, r.source, CAST(floor(r.age / 30) AS INTEGER) AS month, e.v, count(*) OVER (PARTITION BY r.probe) AS n, row_number() OVER (PARTITION BY r.probe ORDER BY r.place) AS k FROM ranked r JOIN e ON e.vec_id = r.doc_id),
alike AS (SELECT a.probe, a.k AS i, b.k AS j, list_cosine_similarity(a.v, b.v) AS s FROM items a JOIN items b ON a.probe = b.probe),
pick AS (
  SELECT probe, 0 AS n, CAST([] AS BIGINT[]) AS chosen FROM (SELECT DISTINCT probe FROM items)
  UNION ALL
  SELECT probe, n + 1, list_append(chosen, k) FROM (
    SELECT f.*, row_number() OVER (PARTITION BY f.probe ORDER BY f.score DESC, f.k) AS first FROM (
      SELECT p.probe, p.n, p.chosen, i.k, {WEIGHT} * (1.0 - (i.k - 1) / CAST(i.n AS DOUBLE)) - {1 - WEIGHT} * coalesce((SELECT max(a.s) FROM alike a WHERE a.probe = p.probe AND a.i = i.k AND list_contains(p.chosen, a.j)), 0) AS score
      FROM pick p JOIN items i ON i.probe = p.probe AND NOT list_contains(p.chosen, i.k)
      WHERE p.n < {PICKS} AND (p.n < {LEAST} OR ((SELECT count(*) FROM items x WHERE x.probe = p.probe AND list_contains(p.chosen, x.k) AND x.source = i.source) < {PER_SOURCE}
        AND (SELECT count(*) FROM items x WHERE x.probe = p.probe AND list_contains(p.chosen, x.k) AND x.month = i.month) < {PER_MONTH}))) f) WHERE first = 1),
ends AS (SELECT probe, arg_max(chosen, n) AS chosen FROM pick GROUP BY 1),
filled AS (SELECT e.probe, e.chosen || (SELECT coalesce(list(k ORDER BY k), []) FROM (SELECT i.k FROM items i WHERE i.probe = e.probe AND NOT list_contains(e.chosen, i.k) ORDER BY i.k LIMIT {PICKS}))[1:{PICKS} - len(e.chosen)] AS chosen FROM ends e)
SELECT f.probe, i.doc_id, CAST(list_position(f.chosen, i.k) AS INTEGER) AS number FROM filled f JOIN items i ON i.probe = f.probe AND list_contains(f.chosen, i.k)
"""


@query(DIVERSE)
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    """Diverse documents of each probe, with quotas by source and month; every group has at most NEAREST rows."""
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = candidates(spark, d).select("probe", "doc_id", "place", "source", F.floor(F.col("age") / 30).cast("int").alias("month")).join(vectors, "doc_id")

    def choose(group: pa.Table) -> pa.Table:
        ranked = sorted(group.to_pylist(), key=lambda r: r["place"])
        picked = diverse(ranked)
        return pa.table({
            "probe": pa.array([ranked[i]["probe"] for i in picked], pa.int64()), "doc_id": pa.array([ranked[i]["doc_id"] for i in picked], pa.int64()),
            "number": pa.array(range(1, len(picked) + 1), pa.int32()),
        })

    return rows.groupBy("probe").applyInArrow(choose, "probe long, doc_id long, number int")


@query("""
WITH asked AS (SELECT conv_id, turn, text, regexp_replace(lower(text), '\\s+', '', 'g') AS norm, conv_id % 5 AS market FROM conversations WHERE role = 'user' AND length(trim(text)) >= 6),
firsts AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY conv_id, turn) AS copy FROM asked),
placed AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY conv_id, turn) AS round FROM firsts WHERE copy = 1)
SELECT conv_id, turn, market, CAST(row_number() OVER (ORDER BY round, market) AS INTEGER) AS place FROM placed WHERE round <= 8 ORDER BY round, market LIMIT 30
""")
def diverse_questions(spark: SparkSession, d: str) -> DataFrame:
    """Different questions, round and round the markets, at most eight of each and thirty in all."""
    asked = load(spark, d, "conversations").where("role = 'user' and length(trim(text)) >= 6")
    asked = asked.select("conv_id", "turn", F.regexp_replace(F.lower("text"), r"\s+", "").alias("norm"), (F.col("conv_id") % 5).alias("market"))
    firsts = asked.groupBy("norm").agg(F.min(F.struct("conv_id", "turn", "market")).alias("x")).select("x.*")
    placed = firsts.withColumn("round", F.row_number().over(Window.partitionBy("market").orderBy("conv_id", "turn"))).where("round <= 8")
    top = placed.orderBy("round", "market").limit(30)
    one = Window.partitionBy(F.lit(0)).orderBy("round", "market")  # thirty rows
    return top.select("conv_id", "turn", "market", F.row_number().over(one).alias("place"))
