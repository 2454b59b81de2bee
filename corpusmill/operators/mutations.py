"""Writes as batch jobs: each query shows the state of a table after a kind of write, or the outcome of each key.

Rows are never changed in place. A write is a join or a union of the old state with what is new, reduced by key, which
is repeatable: a lost executor only computes its part again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.registry import query
from corpusmill.sources import sinks
from corpusmill.sources.tables import load


@query("""
SELECT l_orderkey, count(*) AS lines, CAST(sum(l_linenumber) AS BIGINT) AS numbers, bool_or(fresh) AS replaced FROM (
  SELECT l_orderkey, l_linenumber, false AS fresh FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
  UNION ALL SELECT o_orderkey, 1, true FROM orders WHERE o_orderstatus = 'O') GROUP BY 1
""")
def replace_child_rows(spark: SparkSession, d: str) -> DataFrame:
    """The lines of open orders give way to one new line each; other orders keep theirs, and orders stay as they are."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(False).alias("fresh"))
    fresh = load(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(True).alias("fresh"))
    rows = sinks.replace_children(lines, fresh, "l_orderkey").groupBy("l_orderkey")
    return rows.agg(F.count("*").alias("lines"), F.sum("l_linenumber").cast("long").alias("numbers"), F.bool_or("fresh").alias("replaced"))


@query("""
WITH seen AS (SELECT CAST(ts AS DATE) AS day, coalesce(CASE WHEN event_type <> 'error' THEN user_id END, 0) AS user_key, CASE WHEN event_id % 2 = 0 THEN 'old' ELSE 'new' END AS part, value FROM events)
SELECT day, user_key, count(*) AS calls, count(*) FILTER (part = 'new') AS added, CAST(floor(max(value)) AS BIGINT) AS most FROM seen WHERE user_key = 0 OR user_key IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1, 2
""")
def merge_user_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a day and user added to those there are; no user is a key of its own, users that are gone are left out."""
    user = F.coalesce(F.when(F.col("event_type") != "error", F.col("user_id")), F.lit(0))
    seen = load(spark, d, "events").select(F.to_date("ts").alias("day"), user.alias("user_key"), (F.col("event_id") % 2).alias("part"), F.floor("value").alias("v"))
    counts = lambda part: seen.where(F.col("part") == part).groupBy("day", "user_key").agg(F.count("*").alias("calls"), F.lit(part).alias("p"), F.max("v").alias("most"))
    merged = sinks.merge_counts(counts(0).withColumn("added", F.lit(0).cast("long")).drop("p"), counts(1).withColumn("added", F.col("calls")).drop("p"), ["day", "user_key"], ["calls", "added"], ["most"])
    live = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_key")).union(spark.range(1).select("id"))
    return merged.join(live, "user_key", "left_semi").select("day", "user_key", "calls", "added", "most")


@query("""
WITH daily AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), late AS (SELECT DISTINCT day FROM daily WHERE extract(day FROM day) % 3 = 0)
SELECT day, event_type, n, 1 AS version FROM daily WHERE day NOT IN (SELECT day FROM late) UNION ALL SELECT day, event_type, n * 2, 2 FROM daily WHERE day IN (SELECT day FROM late) AND event_type <> 'error'
UNION ALL SELECT day, '(marker)', 1, 2 FROM late
""")
def overwrite_marked_days(spark: SparkSession, d: str) -> DataFrame:
    """Days computed again replace all their rows, a marker row included; other days stay. Doing it twice changes nothing."""
    daily = load(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).withColumn("version", F.lit(1))
    again = daily.where(F.dayofmonth("day") % 3 == 0)
    fresh = again.where("event_type <> 'error'").select("day", "event_type", (F.col("n") * 2).alias("n"), F.lit(2).alias("version"))
    marker = again.select("day").distinct().select("day", F.lit("(marker)").alias("event_type"), F.lit(1).cast("long").alias("n"), F.lit(2).alias("version"))
    once = sinks.replace_children(daily, fresh.unionByName(marker), "day")
    return sinks.replace_children(once, fresh.unionByName(marker), "day")


@query("""
WITH cut AS (SELECT max(ts)::DATE - 7 AS day FROM events), raw AS (SELECT *, ts::DATE < (SELECT day FROM cut) AS old FROM events)
SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total, 'moved' AS tier FROM raw WHERE old GROUP BY 1, 2
UNION ALL SELECT NULL, event_type, count(*), round(sum(value), 4), 'kept' FROM raw WHERE NOT old GROUP BY event_type
UNION ALL SELECT NULL, NULL, (SELECT count(*) FROM events), NULL, 'all'
""")
def move_to_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Rows older than a week leave the raw tier for hourly buckets. Both tiers are made from one reading of the rows, and
    the counts of moved and kept rows add up to all."""
    events = load(spark, d, "events")
    cut = events.agg(F.date_sub(F.to_date(F.max("ts")), 7).alias("day"))
    raw = events.crossJoin(F.broadcast(cut)).withColumn("old", F.to_date("ts") < F.col("day"))
    both = raw.groupBy(F.when(F.col("old"), F.date_trunc("hour", "ts").cast("timestamp_ntz")).alias("bucket"), "event_type", "old").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    tiers = both.select("bucket", "event_type", "n", "total", F.when(F.col("old"), "moved").otherwise("kept").alias("tier"))
    check = both.agg(F.sum("n").alias("n")).select(F.lit(None).cast("timestamp_ntz").alias("bucket"), F.lit(None).cast("string").alias("event_type"), "n", F.lit(None).cast("double").alias("total"), F.lit("all").alias("tier"))
    return tiers.unionByName(check)


@query("SELECT doc_id, min(lang) AS lang, 'new' AS outcome FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY doc_id UNION ALL SELECT DISTINCT doc_id, NULL, 'there' FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Documents entered into the table of labelled ones: one row for each new key, the keys that are there already told."""
    there = load(spark, d, "labels").where("doc_id is not null").select("doc_id").distinct()
    docs = load(spark, d, "documents").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    new = docs.join(there, "doc_id", "left_anti").withColumn("outcome", F.lit("new"))
    return new.unionByName(there.join(docs, "doc_id", "left_semi").select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit("there").alias("outcome")))


@query("""
WITH aged AS (SELECT *, date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM events)) AS age FROM events)
SELECT event_type, count(*) AS kept, min(ts) AS oldest FROM aged WHERE age <= CASE event_type WHEN 'error' THEN 20 WHEN 'view' THEN 5 ELSE 10 END GROUP BY 1
""")
def retention_purge(spark: SparkSession, d: str) -> DataFrame:
    """What is left after rows beyond the keeping time of their kind are gone."""
    events = load(spark, d, "events")
    last = events.agg(F.to_date(F.max("ts")).alias("last"))
    days = F.when(F.col("event_type") == "error", 20).when(F.col("event_type") == "view", 5).otherwise(10)
    left = events.crossJoin(F.broadcast(last)).where(F.datediff("last", F.to_date("ts")) <= days)
    return left.groupBy("event_type").agg(F.count("*").alias("kept"), F.min("ts").alias("oldest"))


@query("""
SELECT p_partkey, CASE WHEN seen <> now THEN 'changed meanwhile' WHEN fixed = now THEN 'same' ELSE 'repaired' END AS outcome, CASE WHEN seen = now THEN fixed ELSE now END AS price FROM (
  SELECT p_partkey, p_retailprice AS now, CASE WHEN p_partkey % 7 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS seen, CASE WHEN p_size > 25 THEN round(p_retailprice / 10, 2) ELSE p_retailprice END AS fixed FROM part)
""")
def optimistic_repair(spark: SparkSession, d: str) -> DataFrame:
    """A plan of repairs made earlier is carried out only where the value is still what the plan saw."""
    now = F.col("p_retailprice")
    part = load(spark, d, "part")
    plan = part.select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, now + 1).otherwise(now).alias("seen"), F.when(F.col("p_size") > 25, F.round(now / 10, 2)).otherwise(now).alias("fixed"))
    rows = part.select("p_partkey", now.alias("now")).join(plan, "p_partkey")
    outcome = F.when(F.col("seen") != F.col("now"), "changed meanwhile").when(F.col("fixed") == F.col("now"), "same").otherwise("repaired")
    return rows.select("p_partkey", outcome.alias("outcome"), F.when(F.col("seen") == F.col("now"), F.col("fixed")).otherwise(F.col("now")).alias("price"))


@query("""
SELECT user_id, day, count(*) AS calls, count(*) FILTER (k <= quota) AS served, count(*) FILTER (k > quota) AS refused, max(ts) FILTER (k <= quota) AS last_served, min(ts) FILTER (k > quota) AS first_refused FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, ts, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k, CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS quota FROM events) GROUP BY 1, 2
""")
def running_quota(spark: SparkSession, d: str) -> DataFrame:
    """Calls of a user and day counted against the user's quota as they come; a quota of 0 refuses all."""
    of = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    quota = F.when(F.col("user_id") % 4 == 0, 0).when(F.col("user_id") % 4 == 1, 1).otherwise(2)
    rows = load(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "ts", (F.row_number().over(of) <= quota).alias("ok"))
    when = lambda c: F.when(c, F.col("ts"))
    return rows.groupBy("user_id", "day").agg(
        F.count("*").alias("calls"), F.count_if("ok").alias("served"), F.count_if(~F.col("ok")).alias("refused"), F.max(when(F.col("ok"))).alias("last_served"), F.min(when(~F.col("ok"))).alias("first_refused")
    )


@query("""
WITH sent AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -value ELSE value END AS value, CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type END AS event_type, CASE WHEN event_id % 19 = 0 THEN event_id + 1 ELSE event_id END AS key FROM events),
judged AS (SELECT *, CASE WHEN value IS NULL THEN 'no value' WHEN value < 0 THEN 'negative' WHEN event_type = '' THEN 'no type' WHEN row_number() OVER (PARTITION BY key ORDER BY event_id) > 1 THEN 'key taken' ELSE 'ok' END AS outcome FROM sent)
SELECT outcome, count(*) AS n, min(event_id) AS first FROM judged GROUP BY 1
""")
def insert_with_rejects(spark: SparkSession, d: str) -> DataFrame:
    """A batch that goes in row by row: what was entered and why the others were not, counted."""
    i = F.col("event_id")
    value = F.when(i % 11 == 0, None).when(i % 13 == 0, -F.col("value")).otherwise(F.col("value"))
    sent = load(spark, d, "events").select("event_id", value.alias("value"), F.when(i % 17 == 0, "").otherwise(F.col("event_type")).alias("event_type"), F.when(i % 19 == 0, i + 1).otherwise(i).alias("key"))
    again = F.row_number().over(Window.partitionBy("key").orderBy("event_id")) > 1
    outcome = F.when(F.col("value").isNull(), "no value").when(F.col("value") < 0, "negative").when(F.col("event_type") == "", "no type").when(again, "key taken").otherwise("ok")
    return sent.withColumn("outcome", outcome).groupBy("outcome").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("""
WITH asked AS (SELECT doc_id, toxic = 1 AS hide FROM labels), batch AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM asked)
SELECT b.doc_id, CASE WHEN k > 200 THEN 'too many' WHEN d.doc_id IS NULL THEN 'unknown' WHEN NOT hide THEN 'shown' ELSE 'hidden' END AS outcome FROM batch b LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d ON d.doc_id = b.doc_id
""")
def overlay_bulk(spark: SparkSession, d: str) -> DataFrame:
    """A bulk request to hide documents: the first two hundred keys are taken, as the rule has it, and each key is told
    what became of it."""
    asked = load(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("hide"))
    taken = asked.orderBy("doc_id").limit(200).select("doc_id", F.lit(True).alias("taken"))
    known = load(spark, d, "documents").select("doc_id", F.lit(True).alias("known")).distinct()
    rows = asked.join(taken, "doc_id", "left").join(known, "doc_id", "left")
    outcome = F.when(F.col("taken").isNull(), "too many").when(F.col("known").isNull(), "unknown").when(F.col("hide"), "hidden").otherwise("shown")
    return rows.select("doc_id", outcome.alias("outcome"))


@query("""
SELECT conv_id, turn, version, version = max(version) OVER (PARTITION BY conv_id, turn) AND turn <= coalesce(max(CASE WHEN version > 1 THEN turn END) OVER (PARTITION BY conv_id), turn) AS active FROM (
  SELECT conv_id, turn, 1 AS version FROM conversations UNION ALL SELECT conv_id, turn, 2 FROM conversations WHERE role = 'user' AND (conv_id + turn) % 5 = 0)
""")
def supersede_versions(spark: SparkSession, d: str) -> DataFrame:
    """Turns asked again: the older version of a turn is superseded, and so are all turns after the last that was asked
    again."""
    turns = load(spark, d, "conversations").select("conv_id", "turn", "role", F.lit(1).alias("version"))
    log = turns.unionByName(turns.where("role = 'user' and (conv_id + turn) % 5 = 0").withColumn("version", F.lit(2)))
    newest = F.max("version").over(Window.partitionBy("conv_id", "turn"))
    last = F.max(F.when(F.col("version") > 1, F.col("turn"))).over(Window.partitionBy("conv_id"))
    return log.select("conv_id", "turn", "version", ((F.col("version") == newest) & (F.col("turn") <= F.coalesce(last, F.col("turn")))).alias("active"))


def upload_state(age: Column, kind: Column) -> Column:
    """The state of an upload from its last step and how many hours ago that was."""
    return F.when(kind == "error", "failed").when(kind == "purchase", "published").when(age > 48, "expired").when(kind == "click", "reviewing").otherwise("waiting")


@query("""
WITH last AS (SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS kind, max(ts) AS seen, count(*) AS steps FROM events GROUP BY 1),
states AS (SELECT *, CASE WHEN kind = 'error' THEN 'failed' WHEN kind = 'purchase' THEN 'published' WHEN epoch((SELECT max(ts) FROM events) - seen) / 3600 > 48 THEN 'expired' WHEN kind = 'click' THEN 'reviewing' ELSE 'waiting' END AS state FROM last)
SELECT user_id, state, steps, user_id % 10 AS owner, count(*) FILTER (state IN ('waiting', 'reviewing')) OVER (PARTITION BY user_id % 10) >= 5 AS owner_full, count(*) OVER (PARTITION BY user_id % 10, steps) > 1 AS conflict FROM states
""")
def upload_states(spark: SparkSession, d: str) -> DataFrame:
    """Uploads, one a user here: their state by the last step, whether their owner has five or more in flight, and
    whether another upload of the owner bears the same mark."""
    events = load(spark, d, "events")
    end = events.agg(F.max("ts").alias("end"))
    last = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.max("ts").alias("at"), F.count("*").alias("steps")).crossJoin(F.broadcast(end))
    seconds = F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    rows = last.select("user_id", upload_state(seconds / 3.6e9, F.col("kind")).alias("state"), "steps", (F.col("user_id") % 10).alias("owner"))
    flying = rows.groupBy("owner").agg((F.count_if(F.col("state").isin("waiting", "reviewing")) >= 5).alias("owner_full"))
    same = rows.groupBy("owner", "steps").agg((F.count("*") > 1).alias("conflict"))
    return rows.join(flying, "owner").join(same, ["owner", "steps"]).select("user_id", "state", "steps", "owner", "owner_full", "conflict")
