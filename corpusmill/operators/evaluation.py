"""Audits, reconciliation, planning and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.orders import order_score, tau
from corpusmill.plans.ranks import nearest_rank
from corpusmill.plans.registry import query
from corpusmill.sources.tables import load

from .retrieval import nearest

#: Name, severity, table and condition of a violation.
CHECKS = (
    ("negative_quantity", "error", "lineitem", "l_quantity <= 0"),
    ("shipped_before_2000", "warn", "lineitem", "l_shipdate < timestamp '1995-02-01 00:00:00'"),
    ("short_text", "warn", "documents", "length(text) < 50"),
    ("wrong_length", "error", "documents", "n_chars <> length(text)"),
    ("unknown_label", "error", "labels", "quality not in (0, 1) or toxic not in (0, 1)"),
    ("negative_value", "error", "events", "value < 0"),
)


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, '{s}' AS severity, count(*) FILTER ({c}) AS violations FROM {t}" for n, s, t, c in CHECKS))
def audit_suite(spark: SparkSession, d: str) -> DataFrame:
    """Violations of each check; all checks of a table in one pass over it."""
    parts = []
    for name in dict.fromkeys(t for _, _, t, _ in CHECKS):
        own = [c for c in CHECKS if c[2] == name]
        one = load(spark, d, name).agg(*[F.count_if(F.expr(c[3])).alias(c[0]) for c in own])
        parts.append(one.select(F.explode(F.array(*[F.struct(F.lit(c[0]).alias("name"), F.lit(c[1]).alias("severity"), F.col(c[0]).alias("violations")) for c in own])).alias("x")).select("x.*"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


@query("SELECT CASE max(r) WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'ok' END AS worst, count(*) FILTER (r > 1) AS failing FROM (SELECT CASE WHEN v = 0 THEN 1 WHEN severity = 'error' THEN 3 ELSE 2 END AS r FROM ("
       + " UNION ALL ".join(f"SELECT '{s}' AS severity, count(*) FILTER ({c}) AS v FROM {t}" for n, s, t, c in CHECKS) + "))")
def worst_status(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("violations") == 0, 1).when(F.col("severity") == "error", 3).otherwise(2)
    rows = audit_suite(spark, d).select(rank.alias("r"))
    return rows.agg(F.when(F.max("r") == 3, "fail").when(F.max("r") == 2, "warn").otherwise("ok").alias("worst"), F.count_if(F.col("r") > 1).alias("failing"))


@query("SELECT p_name, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT p_brand) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands")).where("n > 1 and brands > 1")


@query("""
SELECT tier, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) * 0.000002::DOUBLE, 6) AS cost FROM (
  SELECT CASE WHEN n_chars > 8000 THEN 'large' WHEN n_chars > 1000 THEN 'medium' ELSE 'small' END AS tier, CAST(ceil(n_chars / 4.0) AS BIGINT) AS tokens FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) GROUP BY 1
""")
def tier_status(spark: SparkSession, d: str) -> DataFrame:
    """What is left to do, by tier, with an estimate of its cost."""
    left = load(spark, d, "documents").join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    tier = F.when(F.col("n_chars") > 8000, "large").when(F.col("n_chars") > 1000, "medium").otherwise("small")
    rows = left.select(tier.alias("tier"), F.ceil(F.col("n_chars") / 4.0).alias("tokens")).groupBy("tier")
    return rows.agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") * 0.000002, 6).alias("cost"))


NEAR = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), p AS (SELECT vec_id AS probe, v AS pv, label AS want FROM e WHERE vec_id % 20 = 0),
near AS (SELECT * FROM (SELECT probe, want, vec_id, label, row_number() OVER (PARTITION BY probe ORDER BY round(1 - list_cosine_similarity(pv, v), 9), vec_id) AS rn FROM p, e WHERE vec_id <> probe) WHERE rn <= 10)
"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """probe, rn, hit: whether each of the ten nearest has the probe's label."""
    vectors = load(spark, d, "embeddings")
    labels = vectors.select("vec_id", "label")
    near = nearest(vectors.where("vec_id % 20 = 0"), vectors, 10).join(labels, "vec_id")
    return near.join(labels.select(F.col("vec_id").alias("probe"), F.col("label").alias("want")), "probe").select("probe", "rn", "vec_id", (F.col("label") == F.col("want")).alias("hit"))


@query(NEAR + "SELECT probe, count(*) FILTER (label = want) / 10.0::DOUBLE AS p_at_10, bool_or(label = want) AS hit, min(rn) FILTER (label = want) AS first_hit FROM near GROUP BY probe")
def eval_precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).groupBy("probe").agg((F.count_if("hit") / 10.0).alias("p_at_10"), F.bool_or("hit").alias("hit"), F.min(F.when(F.col("hit"), F.col("rn"))).cast("long").alias("first_hit"))


@query(NEAR + """
SELECT probe, coalesce(round(sum(hits / rn) FILTER (hit) / count(*) FILTER (hit), 9), 0) AS average_precision FROM (
  SELECT probe, rn, label = want AS hit, count(*) FILTER (label = want) OVER (PARTITION BY probe ORDER BY rn) AS hits FROM near) GROUP BY probe
""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    hits = F.count_if("hit").over(Window.partitionBy("probe").orderBy("rn"))
    rows = judged(spark, d).withColumn("hits", hits).groupBy("probe").agg(F.sum(F.when(F.col("hit"), F.col("hits") / F.col("rn"))).alias("s"), F.count_if("hit").alias("n"))
    return rows.select("probe", F.coalesce(F.round(F.col("s") / F.col("n"), 9), F.lit(0.0)).alias("average_precision"))


def rank_overlap(a: Column, b: Column, p: float = 0.9) -> Column:
    """Rank-biased overlap of two rankings, extrapolated, to the depth of the longer one; the shorter is taken to hold
    nothing more. 1 for equal ones, 0 for those without a common element, null for two empty ones."""
    depth = F.greatest(F.size(a), F.size(b))
    shared = lambda n: F.size(F.array_intersect(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), F.lit(0.0), lambda s, n: s + shared(n) / n * F.pow(F.lit(p), n))
    value = shared(F.greatest(depth, F.lit(1))) / depth * F.pow(F.lit(p), depth) + total * ((1 - p) / p)
    return F.when(depth > 0, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 4))


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id AS probe, v AS pv FROM e WHERE vec_id % 20 = 0),
far AS (SELECT probe, vec_id, round(1 - list_cosine_similarity(pv, v), 9) AS x, round(1 - list_cosine_similarity(pv[1:32], v[1:32]), 9) AS y FROM p, e WHERE vec_id <> probe),
lists AS (SELECT probe, list(vec_id ORDER BY x, vec_id)[1:10] AS a, list(vec_id ORDER BY y, vec_id)[1:10 - CAST(probe % 40 / 20 * 3 AS INTEGER)] AS b FROM far GROUP BY probe)
SELECT probe, round(0.1 / 0.9 * list_sum(list_transform(generate_series(1, 10), lambda n: len(list_intersect(a[1:n], b[1:n])) / n * pow(0.9, n))) + len(list_intersect(a, b)) / 10 * pow(0.9, 10), 4) AS rbo FROM lists
""")
def rbo(spark: SparkSession, d: str) -> DataFrame:
    """Rank-biased overlap of each probe's ten nearest by all dimensions and its ten, or seven, nearest by half of them."""
    vectors = load(spark, d, "embeddings")
    half = vectors.withColumn("embedding", F.slice("embedding", 1, 32))
    lists = lambda v, name: nearest(v.where("vec_id % 20 = 0"), v, 10).groupBy("probe").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "vec_id"))), lambda x: x["vec_id"]).alias(name))
    shorter = F.slice(F.col("b"), F.lit(1), (10 - F.col("probe") % 40 / 20 * 3).cast("int"))
    return lists(vectors, "a").join(lists(half, "b"), "probe").select("probe", rank_overlap(F.col("a"), shorter).alias("rbo"))


@query("""
SELECT *, round((2 * concordant - pairs) / pairs, 6) AS tau FROM (
  SELECT a.conv_id, count(*) AS pairs, count(*) FILTER (length(a.text) < length(b.text)) AS concordant, count(*) FILTER (a.role = b.role) AS within, count(*) FILTER (a.role = b.role AND length(a.text) < length(b.text)) AS concordant_within
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY 1)
""")
def pair_concordance(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of turns in order of length, by conversation, all and of one role: counted while merging, n log n for n turns,
    of which two numbers each lie in a row."""
    rows = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("place"), F.col("role").alias("stream")))).alias("t"))
    out = rows.select("conv_id", order_score(F.col("t")).alias("x")).select("conv_id", "x.*").where("pairs > 0")
    return out.withColumn("tau", F.round(tau(F.col("pairs"), F.col("concordant")), 6))


@query("""
SELECT lang, count(*) AS n, round(sum(n_chars) / sum(estimate), 6) AS ratio, count(*) >= 20 AS reliable FROM (SELECT lang, n_chars, ceil(length(text) / 4.0) * 4.5 AS estimate FROM documents) GROUP BY 1
""")
def calibration_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("lang", "n_chars", (F.ceil(F.length("text") / 4.0) * 4.5).cast("double").alias("estimate")).groupBy("lang")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("n_chars") / F.sum("estimate"), 6).alias("ratio"), (F.count("*") >= 20).alias("reliable"))


@query("""
WITH a AS (SELECT event_type, avg(value) AS m FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, avg(value) AS m FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT event_type, round(b.m - a.m, 4) AS delta, CASE WHEN abs(b.m - a.m) <= 0.02 * a.m THEN 'same' WHEN b.m > a.m THEN 'worse' ELSE 'better' END AS verdict FROM a FULL OUTER JOIN b USING (event_type)
""")
def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of one measure; lower is better, within two percent is the same."""
    events = load(spark, d, "events")
    run = lambda odd, name: events.where(F.col("event_id") % 2 == odd).groupBy("event_type").agg(F.avg("value").alias(name))
    delta = F.col("b") - F.col("a")
    verdict = F.when(F.abs(delta) <= 0.02 * F.col("a"), "same").when(delta > 0, "worse").otherwise("better")
    return run(0, "a").join(run(1, "b"), "event_type", "full_outer").select("event_type", F.round(delta, 4).alias("delta"), verdict.alias("verdict"))


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(DISTINCT md5(text)) AS kinds, quantile_disc(n_chars, 0.5) AS median, max(n_chars) AS most FROM documents GROUP BY 1, 2")
def corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("h"))
    sums = docs.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.countDistinct("h").alias("kinds"), F.max("n_chars").alias("most"))
    return sums.join(nearest_rank(docs, ["lang", "source"], "n_chars", {"median": 0.5}), ["lang", "source"])


@query("SELECT doc_id, c.n = 1 AS consistent FROM documents JOIN (SELECT text, count(DISTINCT lang) AS n FROM documents GROUP BY 1) c USING (text)")
def label_drift(spark: SparkSession, d: str) -> DataFrame:
    """Whether all copies of a text bear the same language."""
    docs = load(spark, d, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("h"))
    kinds = docs.select("h", "lang").distinct().groupBy("h").agg(F.count("*").alias("n"))
    return docs.join(kinds, "h").select("doc_id", (F.col("n") == 1).alias("consistent"))
