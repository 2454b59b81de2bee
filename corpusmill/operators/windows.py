"""Window functions: changes, hash chains, rates, islands, running budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from corpusmill.plans.registry import query
from corpusmill.sources.tables import load

from .signals import CHANGES, base_signals, moves


def by_user() -> WindowSpec:
    """Events of a user in order."""
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query(CHANGES + "SELECT instrument, broker, signal_date, rating, prev_rating FROM moved WHERE rating IS DISTINCT FROM prev_rating AND prev_rating IS NOT NULL")
def lag_rating_changes(spark: SparkSession, d: str) -> DataFrame:
    return moves(base_signals(spark, d)).where("rating <> prev_rating").select("instrument", "broker", "signal_date", "rating", "prev_rating")


@query(CHANGES + "SELECT instrument, broker, signal_date, target, prev_target FROM moved WHERE signal_date >= DATE '2000-01-01' AND prev_target IS NOT NULL")
def lag_target_changes_then_window(spark: SparkSession, d: str) -> DataFrame:
    """The window sees all history; the dates are filtered after it."""
    rows = moves(base_signals(spark, d)).where("signal_date >= date '2000-01-01' and prev_target is not null")
    return rows.select("instrument", "broker", "signal_date", "target", "prev_target")


@query("""
SELECT user_id, date_trunc('hour', ts) AS hour, CAST(sum(CASE WHEN event_type <> prev THEN 1 ELSE 0 END) AS BIGINT) AS transitions FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY 1, 2
""")
def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").withColumn("prev", F.lag("event_type").over(by_user()))
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return rows.groupBy("user_id", hour).agg(F.count_if(F.col("event_type") != F.col("prev")).alias("transitions"))


@query("""
WITH rows AS (SELECT event_id, user_id, md5(event_id || '|' || event_type || '|' || user_id) AS own, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
linked AS (SELECT *, lag(own) OVER (PARTITION BY user_id ORDER BY n) AS prev FROM rows), claimed AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'x' ELSE coalesce(prev, '') END AS stored FROM linked)
SELECT event_id, user_id, stored IS NOT DISTINCT FROM coalesce(prev, '') AS intact FROM claimed
""")
def hash_chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """Each row claims the hash of the row before it; some claims are broken."""
    own = F.md5(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string")).cast("binary"))
    rows = load(spark, d, "events").select("event_id", "user_id", "ts", own.alias("own"))
    rows = rows.withColumn("prev", F.coalesce(F.lag("own").over(by_user()), F.lit("")))
    stored = F.when(F.col("event_id") % 97 == 0, "x").otherwise(F.col("prev"))
    return rows.select("event_id", "user_id", stored.eqNullSafe(F.col("prev")).alias("intact"))


@query("""
SELECT user_id, event_id, round(CASE WHEN value >= prev THEN value - prev END, 6) AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL
""")
def counter_rate_reset(spark: SparkSession, d: str) -> DataFrame:
    """Differences of a counter; after a reset there is none."""
    rows = load(spark, d, "events").withColumn("prev", F.lag("value").over(by_user())).where("prev is not null")
    return rows.select("user_id", "event_id", F.round(F.when(F.col("value") >= F.col("prev"), F.col("value") - F.col("prev")), 6).alias("delta"))


@query("""
SELECT e.user_id, count(*) AS failures FROM events e LEFT JOIN (SELECT user_id, max(ts) AS ok FROM events WHERE event_type = 'purchase' GROUP BY 1) s ON s.user_id = e.user_id
WHERE event_type = 'error' AND (ok IS NULL OR ts > ok) GROUP BY 1
""")
def fail_since_success(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    ok = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("ok"))
    return events.where("event_type = 'error'").join(ok, "user_id", "left").where("ok is null or ts > ok").groupBy("user_id").agg(F.count("*").alias("failures"))


@query("""
WITH gaps AS (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER w, ts) > 21600 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
marked AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM gaps)
SELECT user_id, CAST(island AS BIGINT) AS island, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM marked GROUP BY 1, 2
""")
def islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events without a gap of over six hours."""
    gap = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(by_user()).cast("timestamp"))
    fresh = load(spark, d, "events").withColumn("fresh", F.when(F.coalesce(gap <= 21600, F.lit(False)), 0).otherwise(1))
    marked = fresh.withColumn("island", F.sum("fresh").over(by_user().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy("user_id", "island").agg(F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("n"))


@query("""
SELECT conv_id, turn, role, CAST(n AS INTEGER) AS version, n = total AS active FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
""")
def version_chain(spark: SparkSession, d: str) -> DataFrame:
    of = Window.partitionBy("conv_id")
    rows = load(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(of.orderBy("turn")).alias("version"), F.count("*").over(of).alias("total"))
    return rows.select("conv_id", "turn", "role", "version", (F.col("version") == F.col("total")).alias("active"))


@query("""
SELECT c_nationkey, c_custkey, size, CAST(used AS BIGINT) AS used FROM (
  SELECT c_nationkey, c_custkey, size, sum(size) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS used
  FROM (SELECT c_nationkey, c_custkey, length(c_name) + c_custkey % 13 AS size FROM customer)) WHERE used <= 600
""")
def prefix_budget(spark: SparkSession, d: str) -> DataFrame:
    """Plan until the first item that would exceed the budget: a running sum."""
    size = (F.length("c_name") + F.col("c_custkey") % 13).alias("size")
    of = Window.partitionBy("c_nationkey").orderBy("c_custkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = load(spark, d, "customer").select("c_nationkey", "c_custkey", size)
    return rows.withColumn("used", F.sum("size").over(of)).where("used <= 600").select("c_nationkey", "c_custkey", "size", "used")


@query("SELECT user_id, event_id, lead(event_id) OVER w AS next_event, lag(event_id) OVER w AS prev_event FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def adjacent_rows(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("user_id", "event_id", F.lead("event_id").over(by_user()).alias("next_event"), F.lag("event_id").over(by_user()).alias("prev_event"))
