"""Usage and privacy analytics: daily metrics, suppression, conversations, security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.ranks import interpolated, nearest_rank
from corpusmill.plans.registry import query
from corpusmill.sources.tables import load

#: Cells of fewer users are hidden.
K = 3


def local_date() -> Column:
    """The calendar day eight hours east."""
    return F.to_date(F.col("ts") + F.expr("interval 8 hours"))


def hot(spark: SparkSession, d: str) -> DataFrame:
    """day, entity, hits, users: what events cite, by local day."""
    rows = load(spark, d, "events").select(local_date().alias("day"), F.concat(F.lit("e"), F.get_json_object("props", "$.k")).alias("entity"), "user_id")
    return rows.groupBy("day", "entity").agg(F.count("*").alias("hits"), F.countDistinct("user_id").alias("users"))


def suppressed(cells: DataFrame, k: int = K) -> DataFrame:
    """Counts of cells with fewer than k users become null."""
    low = F.col("users") < k
    return cells.withColumn("hits", F.when(~low, F.col("hits"))).withColumn("hidden", low).withColumn("users", F.when(~low, F.col("users")))


def complementary(cells: DataFrame, key: str, label: str, k: int = K) -> DataFrame:
    """As suppressed; and where exactly one cell of a key is hidden, its least visible cell is hidden too, so that no
    difference from the total tells the one. A key of one hidden cell alone goes."""
    of = Window.partitionBy(key)
    rows = cells.withColumn("low", F.col("users") < k).withColumn("n_low", F.count_if("low").over(of)).withColumn("n", F.count("*").over(of))
    least = F.row_number().over(of.orderBy("low", "hits", label))
    rows = rows.withColumn("hidden", F.col("low") | ((F.col("n_low") == 1) & (least == 1))).where("not (n_low = 1 and n = 1)")
    return rows.select(key, label, F.when(~F.col("hidden"), F.col("hits")).alias("hits"), "hidden")


HOT = """
WITH hot AS (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, 'e' || json_extract_string(props, '$.k') AS entity, count(*) AS hits, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2)
"""


@query("""
SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, count(*) AS asked, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 90) AS slow,
  quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) FILTER (event_type <> 'error') AS p95, round(avg(value) FILTER (event_type = 'view'), 6) AS view_mean, max(value) AS most FROM events GROUP BY 1
""")
def qa_daily(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    rows = load(spark, d, "events").withColumn("day", local_date())
    counts = rows.groupBy("day").agg(
        F.count("*").alias("asked"), F.countDistinct("user_id").alias("users"), F.count_if(kind == "error").alias("failed"), F.count_if(F.col("value") > 90).alias("slow"),
        F.round(F.avg(F.when(kind == "view", F.col("value"))), 6).alias("view_mean"), F.max("value").alias("most"),
    )
    return counts.join(nearest_rank(rows, ["day"], "value", {"p50": 0.5}), "day", "left").join(nearest_rank(rows.where("event_type <> 'error'"), ["day"], "value", {"p95": 0.95}), "day", "left")


@query("""
SELECT CAST(ts AS DATE) AS day, route, count(*) FILTER (flag) AS n FROM (
  SELECT ts, unnest(['small', 'large', 'buying']) AS route, unnest([value < 10, value > 90, event_type = 'purchase']) AS flag FROM events) GROUP BY 1, 2
""")
def route_unpivot(spark: SparkSession, d: str) -> DataFrame:
    flags = {"small": F.col("value") < 10, "large": F.col("value") > 90, "buying": F.col("event_type") == "purchase"}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("route"), v.alias("flag")) for k, v in flags.items()])).alias("x")
    return load(spark, d, "events").select(F.to_date("ts").alias("day"), pairs).groupBy("day", "x.route").agg(F.count_if("x.flag").alias("n"))


@query(HOT + "SELECT day, entity, hits, users FROM hot")
def hot_entities(spark: SparkSession, d: str) -> DataFrame:
    return hot(spark, d)


@query("""
WITH cells AS (SELECT CAST(ts AS DATE) AS day, event_type || '/' || user_id % 10 AS entity, count(*) AS hits, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2)
SELECT day, entity, CASE WHEN users >= 4 THEN hits END AS hits, CASE WHEN users >= 4 THEN users END AS users, users < 4 AS hidden FROM cells
""")
def k_suppress(spark: SparkSession, d: str) -> DataFrame:
    return suppressed(cells(spark, d), 4)


def cells(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").select(F.to_date("ts").alias("day"), F.concat_ws("/", "event_type", (F.col("user_id") % 10).cast("string")).alias("entity"), "user_id")
    return rows.groupBy("day", "entity").agg(F.count("*").alias("hits"), F.countDistinct("user_id").alias("users"))


@query("""
WITH cells AS (SELECT CAST(ts AS DATE) AS day, event_type || '/' || user_id % 10 AS entity, count(*) AS hits, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2),
marked AS (SELECT *, users < 3 AS low, count(*) FILTER (users < 3) OVER (PARTITION BY day) AS n_low, count(*) OVER (PARTITION BY day) AS n, row_number() OVER (PARTITION BY day ORDER BY users < 3, hits, entity) AS least FROM cells)
SELECT day, entity, CASE WHEN NOT (low OR (n_low = 1 AND least = 1)) THEN hits END AS hits, low OR (n_low = 1 AND least = 1) AS hidden FROM marked WHERE NOT (n_low = 1 AND n = 1)
""")
def complementary_suppress(spark: SparkSession, d: str) -> DataFrame:
    return complementary(cells(spark, d), "day", "entity")


@query(HOT + """
, total AS (SELECT entity, CAST(sum(hits) AS BIGINT) AS hits, max(users) AS users FROM hot GROUP BY 1)
SELECT entity, CASE WHEN users >= 14 THEN hits END AS hits, CAST(row_number() OVER (ORDER BY users < 14, CASE WHEN users >= 14 THEN -hits END, entity) AS INTEGER) AS place FROM total ORDER BY place LIMIT 15
""")
def top_open_vocab(spark: SparkSession, d: str) -> DataFrame:
    """Days merged (hits add up, users keep the most), hidden entities last and in no telling order."""
    total = hot(spark, d).groupBy("entity").agg(F.sum("hits").alias("hits"), F.max("users").alias("users"))
    shown = F.when(F.col("users") >= 14, F.col("hits"))
    top = total.orderBy(F.col("users") < 14, F.when(F.col("users") >= 14, -F.col("hits")), "entity").limit(15)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("users") < 14, F.when(F.col("users") >= 14, -F.col("hits")), "entity"))
    return top.select("entity", shown.alias("hits"), place.alias("place"))


@query("""
SELECT day, CAST(sum(n) AS BIGINT) AS n, bool_or(live) AS live FROM (
  SELECT CAST(ts AS DATE) AS day, count(*) AS n, false AS live FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1 UNION ALL SELECT CAST(ts AS DATE), count(*), true FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1) GROUP BY day
""")
def live_plus_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Older days from the rollup, newer ones live, stitched by day."""
    events = load(spark, d, "events")
    part = lambda when, live: events.where(when).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).withColumn("live", F.lit(live))
    both = part("ts < timestamp_ntz '2024-01-20 00:00:00'", False).unionByName(part("ts >= timestamp_ntz '2024-01-20 00:00:00'", True))
    return both.groupBy("day").agg(F.sum("n").alias("n"), F.bool_or("live").alias("live"))


@query("""
SELECT conv_id, arg_min(left(text, 40), turn) FILTER (role = 'user' AND length(text) > 5) AS title, max(turn) AS last_turn, count(*) AS turns, bool_or(contains(lower(text), 'the')) AS matches FROM conversations GROUP BY 1
""")
def conversations_list(spark: SparkSession, d: str) -> DataFrame:
    valid = (F.col("role") == "user") & (F.length("text") > 5)
    return load(spark, d, "conversations").groupBy("conv_id").agg(
        F.min_by(F.substring("text", 1, 40), F.when(valid, F.col("turn"))).alias("title"), F.max("turn").alias("last_turn"), F.count("*").alias("turns"), F.bool_or(F.lower("text").contains("the")).alias("matches")
    )


@query("SELECT conv_id, turn, role, CAST(n AS INTEGER) AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def last_n_turns(spark: SparkSession, d: str) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return load(spark, d, "conversations").select("conv_id", "turn", "role", back.alias("back")).where("back <= 3")


@query("""
SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT event_type) AS kinds, count(DISTINCT CAST(ts AS DATE)) FILTER (event_type = 'error') AS bad_days,
  CASE WHEN count(*) FILTER (event_type = 'error') >= 18 THEN 'high' WHEN count(*) FILTER (event_type = 'error') >= 14 THEN 'medium' ELSE 'low' END AS risk
FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') >= 10
""")
def suspicious_actor(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("event_type") == "error"
    rows = load(spark, d, "events").groupBy("user_id").agg(F.count_if(bad).alias("errors"), F.countDistinct("event_type").alias("kinds"), F.countDistinct(F.when(bad, F.to_date("ts"))).alias("bad_days"))
    return rows.where("errors >= 10").withColumn("risk", F.when(F.col("errors") >= 18, "high").when(F.col("errors") >= 14, "medium").otherwise("low"))


@query("""
SELECT user_id % 10 AS team, round(quantile_cont(age, 0.5), 4) AS median_age, round(quantile_cont(age, 0.9), 4) AS p90_age, round(avg(CASE WHEN age > 20 THEN 1.0 ELSE 0.0 END), 6) AS old_share
FROM (SELECT user_id, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS age FROM events) GROUP BY 1
""")
def citation_ages(spark: SparkSession, d: str) -> DataFrame:
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    rows = load(spark, d, "events").select((F.col("user_id") % 10).alias("team"), age.alias("age"))
    shares = rows.groupBy("team").agg(F.round(F.count_if(F.col("age") > 20) / F.count("*"), 6).alias("old_share"))
    ages = interpolated(rows, ["team"], "age", {"median_age": 0.5, "p90_age": 0.9})
    return shares.join(ages, "team").select("team", F.round("median_age", 4).alias("median_age"), F.round("p90_age", 4).alias("p90_age"), "old_share")


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT CAST(date_trunc('week', ts) AS DATE), 'large', count(*) FROM events WHERE value > 95 GROUP BY 1")
def weekly_operations(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    kinds = rows.groupBy("week", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.unionByName(rows.where("value > 95").groupBy("week").agg(F.count("*").alias("n")).withColumn("kind", F.lit("large")))
