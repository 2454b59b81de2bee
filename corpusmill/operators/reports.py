"""Reports on use, security and quality, evaluation runs against a baseline, and look-ups that feed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.ranks import nearest_rank
from corpusmill.plans.registry import query
from corpusmill.sources.tables import load

from .usage import local_date


MEASURES = """
WITH qa AS (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, user_id, value AS latency, value / 2 AS thinking, event_type = 'error' AS stopped, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""


@query(MEASURES + """
SELECT day, count(*) AS questions, count(DISTINCT user_id) AS askers, count(*) FILTER (stopped) AS stopped, quantile_disc(latency, 0.5) FILTER (NOT stopped) AS lat50, quantile_disc(latency, 0.95) FILTER (NOT stopped) AS lat95,
  count(latency) FILTER (NOT stopped) AS lat_n, quantile_disc(thinking, 0.5) FILTER (NOT stopped) AS th50, quantile_disc(thinking, 0.95) FILTER (NOT stopped) AS th95, count(*) FILTER (k % 7 = 0) AS truncated,
  count(*) FILTER (k % 5 > 3) AS inv_rows, CAST(coalesce(sum(k % 5), 0) AS BIGINT) AS inv_total, count(*) FILTER (event_type = 'purchase') AS likes, count(*) FILTER (event_type = 'signup') AS dislikes,
  count(*) FILTER (k IS NOT NULL) AS checked_all, count(*) FILTER (k % 2 = 0) AS judge_checked, count(*) FILTER (k % 2 = 0 AND k % 3 = 0) AS degraded, count(*) FILTER (k % 2 = 0 AND k / 100.0 < 0.3) AS below_min,
  CAST(coalesce(sum(k) FILTER (k % 2 = 0 AND k % 3 <> 0), 0) AS BIGINT) AS score_sum, count(*) FILTER (k % 2 = 0 AND k % 3 <> 0) AS score_n FROM qa GROUP BY day
""")
def qa_measures(spark: SparkSession, d: str) -> DataFrame:
    """All measures of a day's questions: counts in one pass, percentiles from counted values."""
    k = F.get_json_object("props", "$.k").cast("int")
    qa = load(spark, d, "events").select(local_date().alias("day"), "user_id", F.col("value").alias("latency"), (F.col("value") / 2).alias("thinking"), (F.col("event_type") == "error").alias("stopped"), "event_type", k.alias("k"))
    judged = F.col("k") % 2 == 0
    sound = judged & (F.col("k") % 3 != 0)
    kind = F.col("event_type")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = qa.groupBy("day").agg(
        F.count("*").alias("questions"), F.countDistinct("user_id").alias("askers"), F.count_if("stopped").alias("stopped"), F.count(F.when(~F.col("stopped"), F.col("latency"))).alias("lat_n"),
        F.count_if(F.col("k") % 7 == 0).alias("truncated"), F.count_if(F.col("k") % 5 > 3).alias("inv_rows"), total(F.col("k") % 5).alias("inv_total"), F.count_if(kind == "purchase").alias("likes"),
        F.count_if(kind == "signup").alias("dislikes"), F.count("k").alias("checked_all"), F.count_if(judged).alias("judge_checked"), F.count_if(judged & (F.col("k") % 3 == 0)).alias("degraded"),
        F.count_if(judged & (F.col("k") / 100.0 < 0.3)).alias("below_min"), total(F.when(sound, F.col("k"))).alias("score_sum"), F.count_if(sound).alias("score_n"),
    )
    done = qa.where("not stopped")
    latency = nearest_rank(done, ["day"], "latency", {"lat50": 0.5, "lat95": 0.95})
    return counts.join(latency, "day", "left").join(nearest_rank(done, ["day"], "thinking", {"th50": 0.5, "th95": 0.95}), "day", "left")


@query("""
WITH days AS (SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE + 2, INTERVAL 1 DAY)) AS DATE) AS day FROM events), done AS (SELECT DISTINCT ts::DATE AS day FROM events WHERE event_type = 'purchase' AND extract(day FROM ts) % 4 <> 0)
SELECT day, (SELECT count(*) FROM events e WHERE e.ts::DATE = days.day) AS rows_to_roll FROM days WHERE day NOT IN (SELECT day FROM done)
""")
def missing_rollups(spark: SparkSession, d: str) -> DataFrame:
    """Days of the range without a marker, and how many rows their rollup will read."""
    events = load(spark, d, "events")
    days = events.agg(F.explode(F.sequence(F.to_date(F.min("ts")), F.date_add(F.to_date(F.max("ts")), 2))).alias("day"))
    done = events.where((F.col("event_type") == "purchase") & (F.dayofmonth("ts") % 4 != 0)).select(F.to_date("ts").alias("day")).distinct()
    counts = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.join(done, "day", "left_anti").join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("rows_to_roll"))


@query(MEASURES + """
, bounds AS (SELECT min(day) + 3 AS since, max(day) - 2 AS until FROM qa), weeks AS (SELECT DISTINCT CAST(date_trunc('week', d) AS DATE) AS week FROM (SELECT unnest(generate_series(since, until, INTERVAL 1 DAY)) AS d FROM bounds)),
sums AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, count(*) AS questions, count(*) FILTER (k % 2 = 0) AS judged, avg(k / 100.0) FILTER (k % 2 = 0 AND k % 3 <> 0) AS score FROM qa, bounds WHERE day BETWEEN since AND until GROUP BY 1)
SELECT week, week < since OR week + 6 > until AS partial, coalesce(questions, 0) AS questions, coalesce(judged, 0) AS judged, round(score, 4) AS avg_score FROM weeks CROSS JOIN bounds LEFT JOIN sums USING (week)
""")
def weekly_quality(spark: SparkSession, d: str) -> DataFrame:
    """Weeks of a range with the scores of the present judge only; weeks that the range cuts are marked, empty ones stay."""
    k = F.get_json_object("props", "$.k").cast("int")
    qa = load(spark, d, "events").select(local_date().alias("day"), k.alias("k"))
    bounds = qa.agg(F.date_add(F.min("day"), 3).alias("since"), F.date_sub(F.max("day"), 2).alias("until"))
    monday = lambda c: F.to_date(F.date_trunc("week", c))
    weeks = bounds.select("since", "until", F.explode(F.sequence("since", "until")).alias("d")).select("since", "until", monday("d").alias("week")).distinct()
    inside = qa.crossJoin(F.broadcast(bounds)).where("day between since and until")
    judged = F.col("k") % 2 == 0
    sums = inside.groupBy(monday("day").alias("week")).agg(F.count("*").alias("n"), F.count_if(judged).alias("j"), F.round(F.avg(F.when(judged & (F.col("k") % 3 != 0), F.col("k") / 100.0)), 4).alias("avg_score"))
    partial = (F.col("week") < F.col("since")) | (F.date_add("week", 6) > F.col("until"))
    return weeks.join(sums, "week", "left").select("week", partial.alias("partial"), F.coalesce("n", F.lit(0)).alias("questions"), F.coalesce("j", F.lit(0)).alias("judged"), "avg_score")


@query("""
WITH today AS (SELECT max(ts)::DATE AS day FROM events), used AS (SELECT user_id, event_type AS kind, count(*) AS n FROM events, today WHERE ts::DATE = day GROUP BY 1, 2),
people AS (SELECT DISTINCT user_id FROM events), items AS (SELECT user_id, kind, standard FROM people, (VALUES ('view', 3), ('click', 2), ('purchase', 1)) AS t(kind, standard)),
limits AS (SELECT i.*, coalesce(n, 0) AS used, CASE WHEN user_id % 9 = 0 THEN 'unlimited' WHEN user_id % 7 = 0 THEN 'own' ELSE 'default' END AS mode, CASE WHEN user_id % 9 = 0 THEN NULL WHEN user_id % 7 = 0 THEN standard + 2 ELSE standard END AS most FROM items i LEFT JOIN used u USING (user_id, kind))
SELECT user_id, kind, mode, used, most, CASE WHEN most IS NOT NULL THEN greatest(0, most - used) END AS remaining, CASE WHEN most IS NOT NULL THEN greatest(0, used - most) ELSE 0 END AS over FROM limits
""")
def quota_overview(spark: SparkSession, d: str) -> DataFrame:
    """Every user's use of each kind today, against the default limit, an own one or none."""
    events = load(spark, d, "events")
    today = events.agg(F.to_date(F.max("ts")).alias("day"))
    used = events.crossJoin(F.broadcast(today)).where(F.to_date("ts") == F.col("day")).groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("standard")) for k, n in (("view", 3), ("click", 2), ("purchase", 1))]))
    items = events.select("user_id").distinct().select("user_id", kinds.alias("x")).select("user_id", "x.*")
    mode = F.when(F.col("user_id") % 9 == 0, "unlimited").when(F.col("user_id") % 7 == 0, "own").otherwise("default")
    rows = items.join(used, ["user_id", "kind"], "left").withColumn("used", F.coalesce("n", F.lit(0))).withColumn("mode", mode)
    rows = rows.withColumn("most", F.when(F.col("mode") == "own", F.col("standard") + 2).when(F.col("mode") == "default", F.col("standard")))
    left, over = F.greatest(F.lit(0), F.col("most") - F.col("used")), F.greatest(F.lit(0), F.col("used") - F.col("most"))
    known = F.col("most").isNotNull()
    return rows.select("user_id", "kind", "mode", "used", "most", F.when(known, left).alias("remaining"), F.when(known, over).otherwise(0).alias("over"))


@query("""
WITH recent AS (SELECT *, user_id % 12 AS host FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 72 HOUR)
SELECT * FROM (SELECT host, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'click' AND value > 90) AS locked, count(*) FILTER (event_type = 'signup') AS successes,
  count(DISTINCT user_id) FILTER (event_type = 'error') AS users, min(ts) AS first_seen, max(ts) AS last_seen FROM recent GROUP BY host) WHERE failures + locked >= 5
""")
def suspicious_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts with five or more failed or blocked attempts in the last three days."""
    events = load(spark, d, "events")
    end = events.agg((F.max("ts") - F.expr("interval 72 hours")).alias("since"))
    failed = F.col("event_type") == "error"
    rows = events.crossJoin(F.broadcast(end)).where("ts > since").groupBy((F.col("user_id") % 12).alias("host")).agg(
        F.count_if(failed).alias("failures"), F.count_if((F.col("event_type") == "click") & (F.col("value") > 90)).alias("locked"), F.count_if(F.col("event_type") == "signup").alias("successes"),
        F.countDistinct(F.when(failed, F.col("user_id"))).alias("users"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )
    return rows.where("failures + locked >= 5")


@query("""
WITH win AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 10 DAY), ok AS (SELECT user_id, max(ts) AS seen FROM events WHERE event_type = 'purchase' GROUP BY 1),
accounts AS (SELECT w.user_id, count(*) AS n FROM win w LEFT JOIN ok USING (user_id) WHERE event_type = 'error' AND (seen IS NULL OR ts > seen) GROUP BY 1)
SELECT (SELECT count(*) FROM win WHERE event_type = 'error') AS failures, (SELECT count(*) FROM win WHERE event_type = 'error') >= 100 AS failures_over, coalesce(max(n), 0) AS most, coalesce(list_sort(list(user_id) FILTER (n >= 4)), []) AS accounts_over FROM accounts
""")
def security_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Failures of the last ten days, and the accounts with four or more since their last success."""
    events = load(spark, d, "events")
    end = events.agg((F.max("ts") - F.expr("interval 10 days")).alias("since"))
    win = events.crossJoin(F.broadcast(end)).where("ts > since and event_type = 'error'")
    ok = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("at"))
    accounts = win.join(ok, "user_id", "left").where("at is null or ts > at").groupBy("user_id").agg(F.count("*").alias("n"))
    total = win.agg(F.count("*").alias("failures"), (F.count("*") >= 100).alias("failures_over"))
    return total.crossJoin(accounts.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.array_sort(F.collect_set(F.when(F.col("n") >= 4, F.col("user_id")))).alias("accounts_over")))


RISKS = {"delete": r"^(4-|5-)", "grant": "^1-"}


@query("""
SELECT o_orderkey, category, o_custkey, coalesce(c_name, '(gone)') AS actor FROM (SELECT *, CASE WHEN regexp_matches(o_orderpriority, '^(4-|5-)') THEN 'delete' WHEN regexp_matches(o_orderpriority, '^1-') THEN 'grant' END AS category FROM orders) o
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey WHERE category IS NOT NULL AND o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 300 DAY AND o_orderkey < (SELECT max(o_orderkey) FROM orders) ORDER BY o_orderkey DESC LIMIT 100
""")
def risk_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The latest hundred actions of a risky kind, with who did them, as a page before a key."""
    orders = load(spark, d, "orders")
    ends = orders.agg((F.max("o_orderdate") - F.expr("interval 300 days")).alias("since"), F.max("o_orderkey").alias("before"))
    category = F.coalesce(*[F.when(F.col("o_orderpriority").rlike(p), name) for name, p in RISKS.items()])
    people = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = orders.withColumn("category", category).crossJoin(F.broadcast(ends)).where("category is not null and o_orderdate > since and o_orderkey < before")
    return rows.join(people, "o_custkey", "left").orderBy(F.desc("o_orderkey")).limit(100).select("o_orderkey", "category", "o_custkey", F.coalesce("c_name", F.lit("(gone)")).alias("actor"))


@query("""
WITH users AS (SELECT n_name, c_custkey, c_custkey % 3 = 0 AS enabled, c_mktsegment = 'BUILDING' AS admin FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0),
counts AS (SELECT n_name, count(*) AS users, count(*) FILTER (enabled) AS enabled, count(*) FILTER (admin) AS admins, count(*) FILTER (admin AND enabled) AS admins_enabled FROM users GROUP BY 1)
SELECT c.*, u.c_custkey AS missing FROM counts c LEFT JOIN users u ON u.n_name = c.n_name AND u.admin AND NOT u.enabled
""")
def second_factor_adoption(spark: SparkSession, d: str) -> DataFrame:
    """How many users and administrators of a nation use a second factor, beside each of the latter that doesn't: a row for
    every one of them, and one without for a nation where all do, so that none is left out and no row grows."""
    on, admin = F.col("c_custkey") % 3 == 0, F.col("c_mktsegment") == "BUILDING"
    rows = load(spark, d, "customer").where("c_acctbal > 0").join(F.broadcast(load(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    counts = rows.groupBy("n_name").agg(F.count("*").alias("users"), F.count_if(on).alias("enabled"), F.count_if(admin).alias("admins"), F.count_if(admin & on).alias("admins_enabled"))
    missing = rows.where(admin & ~on).select("n_name", F.col("c_custkey").alias("missing"))
    return counts.join(missing, "n_name", "left").select("n_name", "users", "enabled", "admins", "admins_enabled", "missing")


@query("""
WITH base AS (SELECT o_custkey, max(o_orderdate) AS at FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT o_custkey, o_orderkey, o_orderdate, 'baseline' AS part FROM (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders o WHERE o_orderdate < TIMESTAMP '1998-01-01') WHERE n = 1
UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, 'range' FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
""")
def baseline_and_range(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders of a year, and the last one before it to compare the first with."""
    orders = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    before = orders.where("o_orderdate < timestamp_ntz'1998-01-01'").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x"))
    inside = orders.where("o_orderdate >= timestamp_ntz'1998-01-01' and o_orderdate < timestamp_ntz'1999-01-01'").withColumn("part", F.lit("range"))
    return before.select("o_custkey", "x.o_orderkey", "x.o_orderdate", F.lit("baseline").alias("part")).unionByName(inside)


@query("""
WITH turns AS (SELECT CASE WHEN conv_id % 3 = 0 THEN NULL ELSE conv_id END AS conversation, conv_id * 100 + turn AS id, role FROM conversations)
SELECT coalesce(conversation, id) AS thread, count(*) AS turns, min(id) AS first_id, bool_and(conversation IS NULL) AS single FROM turns GROUP BY 1
""")
def thread_groups(spark: SparkSession, d: str) -> DataFrame:
    """Turns by conversation; one without a conversation is a thread of its own."""
    turns = load(spark, d, "conversations").select(F.when(F.col("conv_id") % 3 != 0, F.col("conv_id")).alias("conversation"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"))
    return turns.groupBy(F.coalesce("conversation", "id").alias("thread")).agg(F.count("*").alias("turns"), F.min("id").alias("first_id"), F.bool_and(F.col("conversation").isNull()).alias("single"))


@query("""
WITH profile AS (SELECT p_brand, count(*) FILTER (p_size > 25) > count(*) / 2.0 AS on_ FROM part GROUP BY 1)
SELECT p_partkey, coalesce(CASE WHEN p_size < 5 THEN 'small' END, CASE WHEN p_type LIKE 'LARGE%' THEN 'large' END, 'plain') AS kind, p_partkey % 2 = 0 AS even FROM part WHERE p_brand IN (SELECT p_brand FROM profile WHERE on_)
""")
def feature_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the kinds that a profile has switched on; a field given beside a row wins over the inferred one."""
    part = load(spark, d, "part")
    on = part.groupBy("p_brand").agg((F.count_if(F.col("p_size") > 25) > F.count("*") / 2.0).alias("on_")).where("on_").select("p_brand")
    kind = F.coalesce(F.when(F.col("p_size") < 5, "small"), F.when(F.col("p_type").startswith("LARGE"), "large"), F.lit("plain"))
    return part.join(on, "p_brand", "left_semi").select("p_partkey", kind.alias("kind"), (F.col("p_partkey") % 2 == 0).alias("even"))


@query("""
WITH fails AS (SELECT user_id, event_id % 2 AS model, count(*) AS rounds, bool_or(value > 99) AS fatal FROM events WHERE event_type = 'error' GROUP BY 1, 2)
SELECT DISTINCT e.user_id, e.event_id % 2 AS model FROM events e WHERE NOT EXISTS (SELECT 1 FROM fails f WHERE f.user_id = e.user_id AND f.model = e.event_id % 2 AND (f.rounds >= 8 OR f.fatal))
""")
def unblocked_work(spark: SparkSession, d: str) -> DataFrame:
    """Work that is not on the block list: failed eight times with the same model, or once for good."""
    events = load(spark, d, "events").select("user_id", (F.col("event_id") % 2).alias("model"), "event_type", "value")
    blocked = events.where("event_type = 'error'").groupBy("user_id", "model").agg(F.count("*").alias("rounds"), F.bool_or(F.col("value") > 99).alias("fatal")).where("rounds >= 8 or fatal")
    return events.select("user_id", "model").distinct().join(blocked, ["user_id", "model"], "left_anti")


@query("""
SELECT o_orderkey, l_linenumber, count(*) AS n, max(l_extendedprice) AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey) GROUP BY 1, 2
""")
def key_set_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a set of orders, each customer's last."""
    keys = load(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    lines = load(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return lines.join(keys, "o_orderkey", "left_semi").groupBy("o_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("price"))


#: Heartbeats: a host's last event, its spool's oldest unread one.
@query("""
WITH beat AS (SELECT user_id % 15 AS host, max(ts) AS last, min(ts) FILTER (event_type = 'signup') AS oldest FROM events GROUP BY 1), now AS (SELECT max(ts) AS seen FROM events)
SELECT host, CASE WHEN beat > 600 THEN 'fail' WHEN spool > 25 * 86400 THEN 'warn' WHEN spool IS NULL THEN 'unknown' ELSE 'ok' END AS status, CAST(floor(beat) AS BIGINT) AS beat_age FROM (SELECT host, epoch(seen - last) AS beat, epoch(seen - oldest) AS spool FROM beat, now)
""")
def heartbeat_age(spark: SparkSession, d: str) -> DataFrame:
    """Hosts whose heartbeat is too old fail, those whose spool waits too long warn."""
    events = load(spark, d, "events")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    beat = events.groupBy((F.col("user_id") % 15).alias("host")).agg(F.max("ts").alias("last"), F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("oldest"))
    rows = beat.crossJoin(F.broadcast(events.agg(F.max("ts").alias("at")))).select("host", (seconds(F.col("at")) - seconds(F.col("last"))).alias("beat"), (seconds(F.col("at")) - seconds(F.col("oldest"))).alias("spool"))
    status = F.when(F.col("beat") > 600, "fail").when(F.col("spool") > 25 * 86400, "warn").when(F.col("spool").isNull(), "unknown").otherwise("ok")
    return rows.select("host", status.alias("status"), F.floor("beat").alias("beat_age"))


@query("""
WITH checks AS (SELECT user_id % 20 AS subject, event_type AS name, max(ts) AS seen, CASE WHEN avg(value) > 60 THEN 'fail' WHEN avg(value) > 52 THEN 'warn' WHEN count(*) < 3 THEN 'unknown' ELSE 'ok' END AS status FROM events GROUP BY 1, 2),
aged AS (SELECT *, CASE WHEN seen < (SELECT max(ts) FROM events) - INTERVAL 2 DAY AND status = 'ok' THEN 'unknown' ELSE status END AS now FROM checks)
SELECT subject, max_by(now, CASE now WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END) AS status, count(*) FILTER (now <> status) AS escalated FROM aged GROUP BY 1
""")
def worst_of_checks(spark: SparkSession, d: str) -> DataFrame:
    """The worst state of a subject's checks: fail, warn, unknown, ok; what was fine two days ago or more is unknown now."""
    events = load(spark, d, "events")
    mean = F.avg("value")
    status = F.when(mean > 60, "fail").when(mean > 52, "warn").when(F.count("*") < 3, "unknown").otherwise("ok")
    checks = events.groupBy((F.col("user_id") % 20).alias("subject"), "event_type").agg(F.max("ts").alias("at"), status.alias("status"))
    end = events.agg((F.max("ts") - F.expr("interval 2 days")).alias("since"))
    aged = checks.crossJoin(F.broadcast(end)).withColumn("now", F.when((F.col("at") < F.col("since")) & (F.col("status") == "ok"), "unknown").otherwise(F.col("status")))
    rank = F.when(F.col("now") == "fail", 3).when(F.col("now") == "warn", 2).when(F.col("now") == "unknown", 1).otherwise(0)
    return aged.groupBy("subject").agg(F.max_by("now", rank).alias("status"), F.count_if(F.col("now") != F.col("status")).alias("escalated"))


RUNS = """
WITH items AS (SELECT user_id % 40 AS question, event_id % 500 AS report, event_id % 3 AS chunk, min(ts) AS created, max(value) AS score FROM events GROUP BY 1, 2, 3),
base AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, report, chunk) AS place FROM items WHERE report % 10 <> 1), baseline AS (SELECT * FROM base WHERE place <= 8),
cut AS (SELECT question, i.report, i.chunk, score FROM items i WHERE report % 10 <> 2 AND NOT (report % 10 = 1 AND created > TIMESTAMP '2024-01-10' AND report NOT IN (SELECT report FROM baseline b WHERE b.question = i.question))),
current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, report, chunk) AS place FROM cut) WHERE place <= 8),
eligible AS (SELECT * FROM baseline WHERE report % 10 <> 3)
"""


def runs(spark: SparkSession, d: str, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """question, report, chunk of a baseline run and of a current one. The baseline lacks reports that came later; of the
    current run, reports newer than the cut-off that the baseline's question hasn't are left out before the first k are
    taken; hidden reports don't count for the baseline."""
    items = load(spark, d, "events").groupBy((F.col("user_id") % 40).alias("question"), (F.col("event_id") % 500).alias("report"), (F.col("event_id") % 3).alias("chunk")).agg(F.min("ts").alias("created"), F.max("value").alias("score"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "report", "chunk"))
    top = lambda rows: rows.withColumn("place", place).where(F.col("place") <= k)
    baseline = top(items.where("report % 10 <> 1"))
    known = baseline.select("question", "report").distinct().withColumn("known", F.lit(True))
    new = (F.col("report") % 10 == 1) & (F.col("created") > F.lit("2024-01-10").cast("timestamp_ntz")) & F.col("known").isNull()
    current = top(items.where("report % 10 <> 2").join(known, ["question", "report"], "left").where(~new))
    return baseline.where("report % 10 <> 3").select("question", "report", "chunk"), current.select("question", "report", "chunk")


@query(RUNS + """
, b AS (SELECT DISTINCT question, report FROM eligible), c AS (SELECT DISTINCT question, report FROM current),
reports AS (SELECT b.question, count(*) AS n, count(c.report) AS kept FROM b LEFT JOIN c ON c.question = b.question AND c.report = b.report GROUP BY 1), gained AS (SELECT c.question, count(*) AS gained FROM c LEFT JOIN b ON b.question = c.question AND b.report = c.report WHERE b.report IS NULL GROUP BY 1),
chunks AS (SELECT e.question, count(*) AS n, count(c.report) AS kept FROM eligible e LEFT JOIN current c ON c.question = e.question AND c.report = e.report AND c.chunk = e.chunk GROUP BY 1)
SELECT r.question, round(r.kept / r.n, 4) AS report_recall, round(k.kept / k.n, 4) AS chunk_recall, r.n - r.kept AS lost, coalesce(gained, 0) AS gained, r.kept / r.n < 0.6 AS degraded FROM reports r JOIN chunks k USING (question) LEFT JOIN gained USING (question)
""")
def regression_recall(spark: SparkSession, d: str) -> DataFrame:
    """How much of a baseline's results each question still finds, by report and chunk."""
    base, now = runs(spark, d)
    b, c = (x.select("question", "report").distinct() for x in (base, now))
    both = b.join(c.withColumn("hit", F.lit(1)), ["question", "report"], "full_outer").join(b.withColumn("was", F.lit(1)), ["question", "report"], "left")
    reports = both.groupBy("question").agg(F.count("was").alias("n"), F.count(F.when(F.col("was") == 1, F.col("hit"))).alias("kept"), F.count_if(F.col("was").isNull()).alias("gained")).where("n > 0")
    chunks = base.join(now.withColumn("hit", F.lit(1)), ["question", "report", "chunk"], "left").groupBy("question").agg(F.count("*").alias("m"), F.count("hit").alias("found"))
    recall = F.col("kept") / F.col("n")
    return reports.join(chunks, "question").select(
        "question", F.round(recall, 4).alias("report_recall"), F.round(F.col("found") / F.col("m"), 4).alias("chunk_recall"), (F.col("n") - F.col("kept")).alias("lost"), "gained", (recall < 0.6).alias("degraded")
    )


@query(RUNS + """
, b AS (SELECT DISTINCT question, report FROM eligible), r AS (SELECT b.question, count(c.report) / count(*) AS recall FROM b LEFT JOIN (SELECT DISTINCT question, report FROM current) c ON c.question = b.question AND c.report = b.report GROUP BY 1)
SELECT (SELECT count(DISTINCT question) FROM items) AS questions, count(*) AS comparable, round(avg(round(recall, 4)), 4) AS mean_recall, count(*) FILTER (recall < 0.6) AS degraded,
  CASE WHEN count(*) < ceil((SELECT count(DISTINCT question) FROM items) / 2.0) THEN 'incomparable' WHEN avg(round(recall, 4)) < 0.8 OR count(*) FILTER (recall < 0.6) > 2 THEN 'degraded' ELSE 'ok' END AS verdict FROM r
""")
def regression_verdict(spark: SparkSession, d: str) -> DataFrame:
    """One verdict on a run: too few questions can be compared, too much was lost, or fine."""
    total = load(spark, d, "events").select((F.col("user_id") % 40).alias("q")).agg(F.countDistinct("q").alias("questions"))
    rows = regression_recall(spark, d).agg(F.count("*").alias("comparable"), F.round(F.avg("report_recall"), 4).alias("mean_recall"), F.count_if("degraded").alias("degraded"), F.avg("report_recall").alias("exact"))
    verdict = F.when(F.col("comparable") < F.ceil(F.col("questions") / 2.0), "incomparable").when((F.col("exact") < 0.8) | (F.col("degraded") > 2), "degraded").otherwise("ok")
    return total.crossJoin(rows).select("questions", "comparable", "mean_recall", "degraded", verdict.alias("verdict"))


@query("""
WITH old AS (SELECT doc_id AS id, md5(text) AS sha, n_chars FROM documents WHERE doc_id % 5 <> 0), new AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN md5(text || '!') ELSE md5(text) END AS sha, n_chars FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.sha <> n.sha THEN 'changed' ELSE 'same' END AS state FROM old o FULL OUTER JOIN new n ON n.id = o.id
""")
def baseline_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """A stored baseline against the present set, by key and digest: only what is the same may be compared."""
    docs = load(spark, d, "documents")
    sha = lambda c: F.md5(c.cast("binary"))
    old = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), sha(F.col("text")).alias("sha"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("id"), sha(changed).alias("now"))
    state = F.when(F.col("sha").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("sha") != F.col("now"), "changed").otherwise("same")
    return old.join(new, "id", "full_outer").select("id", state.alias("state"))


@query("""
WITH scored AS (SELECT user_id % 30 AS question, event_type AS metric, event_id % 3 AS repeat, avg(value / 100) AS score FROM events GROUP BY 1, 2, 3),
merged AS (SELECT question, metric, avg(score) AS score, max(score) - min(score) AS spread, count(*) AS repeats FROM scored GROUP BY 1, 2)
SELECT metric, count(*) AS questions, round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(max(spread), 6) AS widest, count(*) FILTER (repeats < 3) AS incomplete, avg(score) >= 0.5 AS passed FROM merged GROUP BY 1
""")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Metrics over questions that were judged several times: repeats are merged first, then compared with a threshold."""
    scored = load(spark, d, "events").groupBy((F.col("user_id") % 30).alias("question"), F.col("event_type").alias("metric"), (F.col("event_id") % 3).alias("repeat")).agg(F.avg(F.col("value") / 100).alias("s"))
    merged = scored.groupBy("question", "metric").agg(F.avg("s").alias("score"), (F.max("s") - F.min("s")).alias("spread"), F.count("*").alias("repeats"))
    return merged.groupBy("metric").agg(
        F.count("*").alias("questions"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("least"), F.round(F.max("spread"), 6).alias("widest"),
        F.count_if(F.col("repeats") < 3).alias("incomplete"), (F.avg("score") >= 0.5).alias("passed"),
    )


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), asked AS (SELECT a.vec_id, g, list_cosine_similarity(a.v, b.v) AS c FROM e a, (VALUES (1), (2), (3)) AS t(g) JOIN e b ON b.vec_id = a.vec_id + g)
SELECT vec_id, round(avg(c), 6) AS relevancy FROM asked GROUP BY 1
""")
def answer_relevancy(spark: SparkSession, d: str) -> DataFrame:
    """Mean likeness of a question's vector to those of three questions made from its answer, the next three here."""
    from .retrieval import cosine

    v = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    made = v.select(F.explode(F.array(*[F.col("vec_id") - g for g in (1, 2, 3)])).alias("vec_id"), F.col("v").alias("w"))
    return v.join(made, "vec_id").groupBy("vec_id").agg(F.round(F.avg(cosine(F.col("v"), F.col("w"))), 6).alias("relevancy"))


CHAIN = """
WITH RECURSIVE log AS (SELECT o_custkey AS chain, o_orderkey AS id, md5(o_orderkey || '|' || o_orderpriority) AS body, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
stored AS (SELECT chain, id, body, n, md5('' || body) AS row_hash FROM log WHERE n = 1 UNION ALL SELECT l.chain, l.id, l.body, l.n, md5(s.row_hash || l.body) FROM stored s JOIN log l ON l.chain = s.chain AND l.n = s.n + 1)
"""


@query(CHAIN + """
, kept AS (SELECT *, lag(row_hash, 1, '') OVER (PARTITION BY chain ORDER BY id) AS prev FROM (SELECT chain, id, n, CASE WHEN id % 97 = 0 THEN md5(body || '?') ELSE body END AS body, row_hash FROM stored) t),
anchors AS (SELECT chain, max(n) AS n, arg_max(row_hash, n) AS hash FROM stored GROUP BY 1)
SELECT k.chain, count(*) AS entries, count(*) FILTER (md5(prev || body) <> row_hash) AS broken, min(id) FILTER (md5(prev || body) <> row_hash) AS first_broken, bool_or(k.n = a.n AND row_hash = a.hash) AS anchored FROM kept k JOIN anchors a ON a.chain = k.chain GROUP BY 1
""")
def audit_chain(spark: SparkSession, d: str) -> DataFrame:
    """Stored chains of hashes, one for each customer's orders: every entry's hash is computed again from its body and the
    stored hash before it, and the chain's end compared with its anchor. Entries were altered after they were stored."""
    body = F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderpriority").cast("binary"))
    log = load(spark, d, "orders").select(F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("id"), body.alias("body"))
    link = lambda before, b: F.md5(F.concat(before, b).cast("binary"))
    empty = F.struct(F.lit("").alias("hash"), F.array().cast("array<string>").alias("all"))
    folded = log.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("id", "body"))).alias("rows"))  # a customer's orders
    hashes = F.aggregate("rows", empty, lambda s, r: F.transform(F.array(link(s["hash"], r["body"])), lambda h: F.struct(h.alias("hash"), F.concat(s["all"], F.array(h)).alias("all")))[0])["all"]
    stored = folded.select("chain", F.posexplode(F.arrays_zip(F.col("rows.id").alias("id"), F.col("rows.body").alias("body"), hashes.alias("row_hash"))).alias("n", "x")).select("chain", "n", "x.*")
    anchors = stored.groupBy("chain").agg(F.max_by(F.struct("n", "row_hash"), "n").alias("anchor"))
    altered = F.when(F.col("id") % 97 == 0, F.md5(F.concat("body", F.lit("?")).cast("binary"))).otherwise(F.col("body"))
    before = F.lag("row_hash", 1, "").over(Window.partitionBy("chain").orderBy("id"))
    checked = stored.select("chain", "id", "n", "row_hash", (link(before, altered) != F.col("row_hash")).alias("broken")).join(anchors, "chain")
    end = (F.col("n") == F.col("anchor.n")) & (F.col("row_hash") == F.col("anchor.row_hash"))
    return checked.groupBy("chain").agg(F.count("*").alias("entries"), F.count_if("broken").alias("broken"), F.min(F.when(F.col("broken"), F.col("id"))).alias("first_broken"), F.bool_or(end).alias("anchored"))


@query(r"""
WITH facts AS (SELECT l_orderkey, l_linenumber, l_returnflag || ': ' || CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR) || ' of ' || max(l_partkey) AS line FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag)
SELECT l_orderkey, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY l_linenumber, line)) AS digest FROM facts GROUP BY 1
""")
def rendered_facts(spark: SparkSession, d: str) -> DataFrame:
    """An order's facts as ordered lines of text."""
    line = F.concat("l_returnflag", F.lit(": "), F.max("l_quantity").cast("long").cast("string"), F.lit(" of "), F.max("l_partkey").cast("string"))
    facts = load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]), "\n")
    return facts.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.md5(text.cast("binary")).alias("digest"))


@query(r"""
WITH spans AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents)
SELECT doc_id, md5(CASE WHEN len(p) >= 3 THEN array_to_string(list_concat(p[1:1], p[3:]), chr(10)) ELSE text END) AS digest, CASE WHEN len(p) >= 3 THEN length(p[2]) + 1 ELSE 0 END AS cut FROM spans
""")
def cut_spans(spark: SparkSession, d: str) -> DataFrame:
    """Texts without a span given by its places, that of the second line where there are three; a span beyond the text cuts nothing."""
    start = F.instr("text", "\n")
    size = F.length(F.get(F.split("text", "\n"), F.lit(1))) + 1
    ok = (F.size(F.split("text", "\n")) >= 3) & (start + size <= F.length("text"))
    left = F.concat(F.substring(F.col("text"), F.lit(1), start), F.substring(F.col("text"), start + size + 1, F.length("text")))
    return load(spark, d, "documents").select("doc_id", F.md5(F.when(ok, left).otherwise(F.col("text")).cast("binary")).alias("digest"), F.when(ok, size).otherwise(0).cast("long").alias("cut"))


@query("""
WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT user_id, event_type, CAST(sum(n) AS BIGINT) AS n, count(DISTINCT day) AS days FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2
""")
def json_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters kept as JSON objects, one a day and user, merged key by key and read back."""
    daily = load(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type", (F.col("event_id") % 2).alias("part")).agg(F.count("*").alias("n"))
    stored = daily.groupBy("user_id", "day", "part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "n")))).alias("counters"))
    read = stored.select("user_id", "day", F.explode(F.from_json("counters", "map<string,bigint>")).alias("event_type", "n"))
    return read.groupBy("user_id", "event_type").agg(F.sum("n").alias("n"), F.countDistinct("day").alias("days"))


@query(r"""
WITH cited AS (SELECT conv_id, turn, md5(conv_id || ':' || text)[1:12] AS evidence_id, role, length(text) AS size FROM conversations), ledgers AS (SELECT *, 'first' AS ledger FROM cited WHERE turn % 2 = 0 UNION ALL SELECT *, 'second' FROM cited WHERE turn % 3 = 0)
SELECT conv_id, evidence_id, min(turn) AS first_turn, count(DISTINCT ledger) AS ledgers, count(DISTINCT role) > 1 OR max(size) = 0 AS invalid FROM ledgers GROUP BY 1, 2
""")
def evidence_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a conversation under ids derived from what it says, two ledgers merged and checked."""
    ident = F.substring(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), "text").cast("binary")), 1, 12)
    cited = load(spark, d, "conversations").select("conv_id", "turn", ident.alias("evidence_id"), "role", F.length("text").alias("size"))
    both = cited.where("turn % 2 = 0").withColumn("ledger", F.lit("first")).unionByName(cited.where("turn % 3 = 0").withColumn("ledger", F.lit("second")))
    return both.groupBy("conv_id", "evidence_id").agg(F.min("turn").alias("first_turn"), F.countDistinct("ledger").alias("ledgers"), ((F.countDistinct("role") > 1) | (F.max("size") == 0)).alias("invalid"))


@query("""
SELECT event_id, len(list_filter(from_json(a, '["JSON"]'), lambda x: json_type(x) = 'OBJECT')) AS items, CAST(json_extract_string(a, '$[0].k') AS INTEGER) AS first_k, json_extract_string(t, '$.outlook.stance') AS outlook, json_type(t, '$.risk') = 'OBJECT' AS has_risk FROM (
  SELECT event_id, '[' || props || ', 5, "x", {"k": ' || event_id % 10 || '}]' AS a, '{"outlook": {"stance": "' || event_type || '"}, "risk": ' || CASE WHEN event_id % 2 = 0 THEN '{}' ELSE '3' END || ', "other": {}}' AS t FROM events)
""")
def typed_json(spark: SparkSession, d: str) -> DataFrame:
    """A JSON array as rows of a type, items of another kind passed over, and an object as cells over fixed keys."""
    k = (F.col("event_id") % 10).cast("string")
    array = F.concat(F.lit("["), "props", F.lit(', 5, "x", {"k": '), k, F.lit("}]"))
    thesis = F.concat(F.lit('{"outlook": {"stance": "'), "event_type", F.lit('"}, "risk": '), F.when(F.col("event_id") % 2 == 0, "{}").otherwise("3"), F.lit(', "other": {}}'))
    rows = load(spark, d, "events").select("event_id", F.from_json(array, "array<string>").alias("raw"), F.from_json(thesis, "map<string,string>").alias("cells"))
    objects = F.filter("raw", lambda x: x.startswith("{"))
    cell = lambda name: F.try_element_at("cells", F.lit(name))
    return rows.select(
        "event_id", F.size(objects).cast("long").alias("items"), F.get_json_object(F.get(objects, F.lit(0)), "$.k").cast("int").alias("first_k"),
        F.get_json_object(cell("outlook"), "$.stance").alias("outlook"), cell("risk").startswith("{").alias("has_risk"),
    )
