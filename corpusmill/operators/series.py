"""Time series and monitoring: rollups, late merges, incidents, jobs, freshness, dependency health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.graphs import reached
from corpusmill.plans.ranks import interpolated
from corpusmill.plans.registry import query
from corpusmill.sources.tables import load

from .joins import GRAPH, graph

FIVE = """
WITH obs AS (SELECT event_id, ts, user_id % 5 AS host, event_type AS subject, value, lag(CAST(value > 50 AS INTEGER)) OVER (PARTITION BY user_id % 5, event_type ORDER BY ts, event_id) AS prev, CAST(value > 50 AS INTEGER) AS state FROM events),
five AS (
  SELECT host, subject, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, count(*) AS n, sum(value) AS total, min(value) AS low, max(value) AS high, arg_max(value, struct_pack(a := ts, b := event_id)) AS last,
    arg_min(state, struct_pack(a := ts, b := event_id)) AS first_state, arg_max(state, struct_pack(a := ts, b := event_id)) AS last_state FROM obs GROUP BY 1, 2, 3)
"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    """event_id, ts, host, subject, value, state of every event."""
    return load(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 5).alias("host"), F.col("event_type").alias("subject"), "value", (F.col("value") > 50).cast("int").alias("state"))


def buckets(rows: DataFrame, width: str) -> DataFrame:
    """Mergeable partials of each (host, subject) and time bucket."""
    at = F.struct("ts", "event_id")
    return rows.groupBy("host", "subject", F.window("ts", width).alias("w")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", at).alias("last"),
        F.min_by("state", at).alias("first_state"), F.max_by("state", at).alias("last_state"),
    ).select("host", "subject", F.col("w.start").cast("timestamp_ntz").alias("bucket"), "n", "total", "low", "high", "last", "first_state", "last_state")


def merged(partials: DataFrame, bucket: Column) -> DataFrame:
    """Partials of finer or overlapping buckets put together: counts and sums add up, first and last go by time, and a
    change of state between two partials counts as one."""
    of = Window.partitionBy("host", "subject").orderBy("bucket")
    seam = F.coalesce(F.lag("last_state").over(of) != F.col("first_state"), F.lit(False))
    rows = partials.withColumn("change", (seam.cast("int") + (F.col("first_state") != F.col("last_state")).cast("int")).cast("long")).withColumn("fine", F.col("bucket")).withColumn("bucket", bucket)
    return rows.groupBy("host", "subject", "bucket").agg(
        F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"), F.max_by("last", "fine").alias("last"), F.sum("change").alias("changes")
    )


@query(FIVE + "SELECT host, subject, bucket, n, round(total / n, 6) AS mean, low, high, last FROM five")
def rollup_5m(spark: SparkSession, d: str) -> DataFrame:
    rows = buckets(observations(spark, d), "5 minutes")
    return rows.select("host", "subject", "bucket", "n", F.round(F.col("total") / F.col("n"), 6).alias("mean"), "low", "high", "last")


@query(FIVE + """
, seams AS (SELECT *, coalesce(lag(last_state) OVER (PARTITION BY host, subject ORDER BY bucket) <> first_state, false)::INT + (first_state <> last_state)::INT AS change FROM five)
SELECT host, subject, date_trunc('hour', bucket) AS bucket, CAST(sum(n) AS BIGINT) AS n, round(sum(total) / sum(n), 6) AS mean, min(low) AS low, max(high) AS high, arg_max(last, bucket) AS last, CAST(sum(change) AS BIGINT) AS changes FROM seams GROUP BY 1, 2, 3
""")
def rollup_1h_from_5m(spark: SparkSession, d: str) -> DataFrame:
    return merged(buckets(observations(spark, d), "5 minutes"), F.date_trunc("hour", "bucket").cast("timestamp_ntz"))


@query(FIVE + "SELECT host, subject, bucket, n, round(total / n, 6) AS mean, low, high, last FROM five")
def merge_late(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth observation arrives late; its buckets merge into those that exist, none is dropped."""
    rows = observations(spark, d)
    both = buckets(rows.where("event_id % 10 <> 0"), "5 minutes").withColumn("at", F.lit(0)).unionByName(buckets(rows.where("event_id % 10 = 0"), "5 minutes").withColumn("at", F.lit(1)))
    latest = rows.groupBy("host", "subject", F.window("ts", "5 minutes").alias("w")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("newest"))
    latest = latest.select("host", "subject", F.col("w.start").cast("timestamp_ntz").alias("bucket"), "newest")
    sums = both.groupBy("host", "subject", "bucket").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))
    return sums.join(latest, ["host", "subject", "bucket"]).withColumnRenamed("newest", "last")


@query("""
SELECT CASE WHEN age < 86400 THEN 'raw' WHEN age < 604800 THEN '5m' ELSE '1h' END AS tier, count(*) AS n, min(event_id) AS first_event FROM (
  SELECT event_id, date_diff('second', ts, (SELECT max(ts) FROM events)) AS age FROM events) GROUP BY 1
""")
def retention_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Resolution by age: raw for a day, five minutes for a week, then hours."""
    events = load(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    seconds = lambda c: F.unix_seconds(F.date_trunc("second", c).cast("timestamp"))
    age = seconds("now") - seconds("ts")
    rows = events.crossJoin(F.broadcast(now)).select("event_id", F.when(age < 86400, "raw").when(age < 604800, "5m").otherwise("1h").alias("tier"))
    return rows.groupBy("tier").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""
SELECT user_id, count(*) AS n, arg_min(value, struct_pack(a := ts, b := event_id)) FILTER (event_type = 'error') AS first_summary, min(ts) FILTER (event_type = 'purchase') AS resolved_at,
  arg_max(event_type, struct_pack(a := ts, b := event_id)) FILTER (event_type <> 'purchase') AS last_state, min(ts) AS opened_at, max(ts) AS last_at FROM events GROUP BY 1
""")
def incident_projection(spark: SparkSession, d: str) -> DataFrame:
    """An incident (user) from its events: first firing one, first resolution, last state."""
    at, kind = F.struct("ts", "event_id"), F.col("event_type")
    return load(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.min_by("value", F.when(kind == "error", at)).alias("first_summary"), F.min(F.when(kind == "purchase", F.col("ts"))).alias("resolved_at"),
        F.max_by("event_type", F.when(kind != "purchase", at)).alias("last_state"), F.min("ts").alias("opened_at"), F.max("ts").alias("last_at"),
    )


@query("""
WITH ranked AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'lost' END AS state, ts, event_id FROM events WHERE event_type IN ('signup', 'purchase', 'error'))
SELECT user_id, arg_max(state, struct_pack(p := CASE state WHEN 'finished' THEN 2 WHEN 'lost' THEN 1 ELSE 0 END, a := ts, b := event_id)) AS state, max(ts) AS seen_at, CAST(count(*) FILTER (state = 'running') AS BIGINT) AS starts FROM ranked GROUP BY 1
""")
def job_states(spark: SparkSession, d: str) -> DataFrame:
    """Guarded upsert of job states: finished beats lost beats running."""
    kind = F.col("event_type")
    state = F.when(kind == "signup", "running").when(kind == "purchase", "finished").when(kind == "error", "lost")
    rank = F.when(kind == "purchase", 2).when(kind == "error", 1).otherwise(0)
    rows = load(spark, d, "events").where(kind.isin("signup", "purchase", "error")).withColumn("state", state).withColumn("rank", rank)
    return rows.groupBy("user_id").agg(F.max_by("state", F.struct("rank", "ts", "event_id")).alias("state"), F.max("ts").alias("seen_at"), F.count_if(F.col("state") == "running").alias("starts"))


@query("""
WITH last AS (SELECT event_type, user_id % 5 AS host, max(ts) AS latest FROM events GROUP BY 1, 2), now AS (SELECT max(ts) AS t FROM events)
SELECT event_type, host, date_diff('hour', date_trunc('hour', latest), date_trunc('hour', t)) AS hours, CASE WHEN date_diff('hour', date_trunc('hour', latest), date_trunc('hour', t)) >= 12 THEN 'fail' WHEN date_diff('hour', date_trunc('hour', latest), date_trunc('hour', t)) >= 4 THEN 'warn' ELSE 'ok' END AS state FROM last, now
""")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    """How old the last observation of each series is."""
    last = load(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("host")).agg(F.max("ts").alias("at"))
    now = last.agg(F.max("at").alias("t"))
    hour = lambda c: F.unix_seconds(F.date_trunc("hour", c).cast("timestamp"))
    hours = ((hour("t") - hour("at")) / 3600).cast("long")
    rows = last.crossJoin(F.broadcast(now)).select("event_type", "host", hours.alias("hours"))
    return rows.withColumn("state", F.when(F.col("hours") >= 12, "fail").when(F.col("hours") >= 4, "warn").otherwise("ok"))


@query("""
SELECT CAST(ts AS DATE) AS day, event_type AS metric, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, arg_max(value, struct_pack(a := ts, b := event_id)) AS last FROM events GROUP BY 1, 2
""")
def gauge_day_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("metric"))
    return rows.agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))


@query("""
SELECT host, count(*) AS minutes, round(quantile_cont(total, 0.95), 4) AS p95, max(total) AS most, round(quantile_cont(total, 0.5) FILTER (total > 50), 4) AS active_p50 FROM (
  SELECT user_id % 5 AS host, date_trunc('minute', ts) AS m, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) GROUP BY host
""")
def resource_report(spark: SparkSession, d: str) -> DataFrame:
    """Sum within a minute, then quantiles over minutes, also of busy ones alone."""
    minutes = load(spark, d, "events").groupBy((F.col("user_id") % 5).alias("host"), F.date_trunc("minute", "ts").alias("m")).agg(F.round(F.sum("value"), 4).alias("total"))
    counts = minutes.groupBy("host").agg(F.count("*").alias("minutes"), F.max("total").alias("most"))
    every, busy = interpolated(minutes, ["host"], "total", {"p95": 0.95}), interpolated(minutes.where("total > 50"), ["host"], "total", {"p50": 0.5})
    return counts.join(every, "host").join(busy, "host", "left").select("host", "minutes", F.round("p95", 4).alias("p95"), "most", F.round("p50", 4).alias("active_p50"))


@query(GRAPH + """
, down AS (SELECT node FROM placed WHERE o_orderstatus = 'F'), hit AS (SELECT r.node, count(*) AS n FROM reach r JOIN down ON down.node = r.ancestor WHERE r.node <> r.ancestor GROUP BY 1)
SELECT p.node, o_orderstatus = 'F' AS is_down, hit.node IS NOT NULL AS affected, o_orderstatus = 'F' AND hit.node IS NULL AS root_cause FROM placed p LEFT JOIN hit ON hit.node = p.node
""")
def dependency_health(spark: SparkSession, d: str) -> DataFrame:
    """Down, affected by another node upstream that is down, or the root cause: down, and nothing upstream is. On a cycle a
    node isn't its own cause."""
    nodes, edges = graph(spark, d)
    nodes = nodes.select("node", (F.col("status") == "F").alias("is_down"))
    hit = reached(nodes.where("is_down"), edges).where("low <> node or high <> node").select("node", F.lit(True).alias("hit"))
    rows = nodes.join(hit, "node", "left").select("node", "is_down", F.coalesce("hit", F.lit(False)).alias("affected"))
    return rows.withColumn("root_cause", F.col("is_down") & ~F.col("affected"))


@query("""
SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n, CASE WHEN row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY count(*) DESC, user_id) <= 2 THEN user_id END AS shown FROM events GROUP BY 1, 2
""")
def throttled_tally(spark: SparkSession, d: str) -> DataFrame:
    """Tallies of a minute; keys beyond the first two are not named."""
    minute = F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")
    rows = load(spark, d, "events").groupBy("user_id", minute).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("minute").orderBy(F.desc("n"), "user_id"))
    return rows.select("user_id", "minute", "n", F.when(place <= 2, F.col("user_id")).alias("shown"))
