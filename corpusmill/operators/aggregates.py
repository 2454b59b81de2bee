"""Aggregations: filtered, distinct, grouping sets, percentiles, facets, calendars, partial merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.ranks import interpolated, nearest_rank
from corpusmill.plans.registry import query
from corpusmill.sources.tables import load


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, max(l_shipdate) AS last_ship, min(l_discount) AS least_discount
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2
""")
def agg_basic(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '2000-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus")
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return rows.agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), revenue.alias("revenue"), F.max("l_shipdate").alias("last_ship"), F.min("l_discount").alias("least_discount"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days, list_sort(list(DISTINCT user_id % 7)) AS remainders FROM events GROUP BY 1")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"), F.array_sort(F.collect_set(F.col("user_id") % 7)).alias("remainders"))


@query("""
SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase' AND value > 50) AS large, bool_or(event_type = 'signup') AS signed_up,
  max(ts) FILTER (event_type = 'error') AS last_error, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS failure_rate FROM events GROUP BY 1
""")
def agg_filtered(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return load(spark, d, "events").groupBy("user_id").agg(
        F.count_if(kind == "error").alias("errors"), F.count_if((kind == "purchase") & (F.col("value") > 50)).alias("large"), F.bool_or(kind == "signup").alias("signed_up"),
        F.max(F.when(kind == "error", F.col("ts"))).alias("last_error"), F.round(F.count_if(kind == "error") / F.count("*"), 6).alias("failure_rate"),
    )


@query("""
SELECT event_type, user_id % 5 AS host, CAST(GROUPING(event_type) AS INTEGER) AS all_types, count(*) AS n, quantile_cont(value, 0.5) AS median
FROM events GROUP BY GROUPING SETS ((event_type, user_id % 5), (event_type), ())
""")
def grouping_sets_incident(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").withColumn("host", F.col("user_id") % 5)
    sets = [[F.col("event_type"), F.col("host")], [F.col("event_type")], []]
    counts = rows.groupingSets(sets, F.col("event_type"), F.col("host")).agg(F.grouping("event_type").cast("int").alias("all_types"), F.count("*").alias("n"))
    none = lambda *names: [F.lit(None).cast("string" if c == "event_type" else "long").alias(c) for c in names]
    # medians of each set by themselves, since the whole table is one group that no task should hold
    by_host = interpolated(rows, ["event_type", "host"], "value", {"median": 0.5})
    by_type = interpolated(rows, ["event_type"], "value", {"median": 0.5}).select("event_type", *none("host"), "median")
    every = interpolated(rows, [], "value", {"median": 0.5}).select(*none("event_type", "host"), "median")
    medians = by_host.unionByName(by_type).unionByName(every).select(F.col("event_type").alias("t"), F.col("host").alias("h"), "median")
    return counts.join(medians, F.col("event_type").eqNullSafe(F.col("t")) & F.col("host").eqNullSafe(F.col("h"))).drop("t", "h")


@query("""
SELECT user_id, arg_min(event_type, struct_pack(a := ts, b := event_id)) AS first_type, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS last_type,
  arg_max(value, struct_pack(a := ts, b := event_id)) FILTER (event_type = 'purchase') AS last_purchase FROM events GROUP BY 1
""")
def first_last_by_order(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return load(spark, d, "events").groupBy("user_id").agg(
        F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"), F.max_by("value", F.when(F.col("event_type") == "purchase", at)).alias("last_purchase")
    )


@query("SELECT DISTINCT ON (source, lang) source, lang, doc_id, n_chars FROM documents ORDER BY source, lang, n_chars DESC, doc_id")
def distinct_on(spark: SparkSession, d: str) -> DataFrame:
    first = F.max_by(F.struct("doc_id", "n_chars"), F.struct("n_chars", -F.col("doc_id")))
    return load(spark, d, "documents").groupBy("source", "lang").agg(first.alias("x")).select("source", "lang", "x.doc_id", "x.n_chars")


@query("""
SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, quantile_disc(value, 0.5) FILTER (user_id % 2 = 0) AS even_p50 FROM events GROUP BY 1
""")
def pct_disc_latency(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles."""
    events = load(spark, d, "events")
    every = nearest_rank(events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return every.join(nearest_rank(events.where("user_id % 2 = 0"), ["event_type"], "value", {"even_p50": 0.5}), "event_type", "left")


@query("""
SELECT user_id % 5 AS host, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, max(value) AS most, round(avg(value), 6) AS mean FROM events WHERE event_type = 'error' GROUP BY 1
""")
def pct_cont_mttr(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").where("event_type = 'error'").select((F.col("user_id") % 5).alias("host"), "value")
    sums = rows.groupBy("host").agg(F.count("*").alias("n"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))
    return sums.join(interpolated(rows, ["host"], "value", {"p50": 0.5, "p90": 0.9}), "host").select("host", "n", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"), "most", "mean")


@query("""
SELECT p_brand, min(u) AS low, round(quantile_cont(u, 0.25), 6) AS q1, round(quantile_cont(u, 0.5), 6) AS q2, round(quantile_cont(u, 0.75), 6) AS q3, max(u) AS high
FROM (SELECT p_brand, l_extendedprice / l_quantity AS u FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1
""")
def quartiles_target(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", (F.col("l_extendedprice") / F.col("l_quantity")).alias("u"))
    ends = rows.groupBy("p_brand").agg(F.min("u").alias("low"), F.max("u").alias("high"))
    q = interpolated(rows, ["p_brand"], "u", {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return ends.join(q, "p_brand").select("p_brand", "low", *[F.round(f"q{i}", 6).alias(f"q{i}") for i in (1, 2, 3)], "high")


@query("SELECT o_custkey % 100 AS bucket, CAST(floor(quantile_cont(3 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 0.5) + 0.5) AS INTEGER) AS median FROM orders GROUP BY 1")
def ordinal_median_rating(spark: SparkSession, d: str) -> DataFrame:
    from .signals import median_rating

    return load(spark, d, "orders").groupBy((F.col("o_custkey") % 100).alias("bucket")).agg(median_rating(3 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("median"))


@query("""
SELECT 'lang' AS dim, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'size', CASE WHEN n_chars < 1000 THEN 'small' WHEN n_chars < 5000 THEN 'medium' ELSE 'large' END, count(*) FROM documents GROUP BY 2
""")
def facets_documents(spark: SparkSession, d: str) -> DataFrame:
    """All facets in one pass over the filtered base."""
    size = F.when(F.col("n_chars") < 1000, "small").when(F.col("n_chars") < 5000, "medium").otherwise("large")
    pairs = F.array(*[F.struct(F.lit(k).alias("dim"), v.alias("value")) for k, v in (("lang", F.col("lang")), ("source", F.col("source")), ("size", size))])
    return load(spark, d, "documents").select(F.explode(pairs).alias("x")).groupBy("x.dim", "x.value").agg(F.count("*").alias("n"))


@query("""
SELECT p_brand, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3 ORDER BY n DESC, p_brand LIMIT 20
""")
def having_subset(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand")
    return rows.agg(F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("n")).where("suppliers >= 3").orderBy(F.desc("n"), "p_brand").limit(20)


@query("""
SELECT day, count(*) AS users, max(n) AS most, quantile_disc(n, 0.5) AS median, CAST(count(*) FILTER (n > 5) AS BIGINT) AS heavy FROM (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY day
""")
def two_level_quota_stats(spark: SparkSession, d: str) -> DataFrame:
    per_user = load(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"))
    return per_user.groupBy("day").agg(F.count("*").alias("users"), F.max("n").alias("most"), F.expr("percentile_disc(0.5) within group (order by n)").cast("long").alias("median"), F.count_if(F.col("n") > 5).alias("heavy"))


@query("""
SELECT CAST(ts AS DATE) AS day, event_type AS task, user_id % 3 AS model, count(*) AS calls, count(*) FILTER (value < 10) AS failures, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS tokens
FROM events GROUP BY GROUPING SETS ((CAST(ts AS DATE)), (event_type), (user_id % 3), (CAST(ts AS DATE), event_type, user_id % 3), ())
""")
def token_totals_grouping(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("event_type").alias("task"), (F.col("user_id") % 3).alias("model"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    day, task, model = F.col("day"), F.col("task"), F.col("model")
    return rows.groupingSets([[day], [task], [model], [day, task, model], []], day, task, model).agg(F.count("*").alias("calls"), F.count_if(F.col("value") < 10).alias("failures"), F.sum("k").cast("long").alias("tokens"))


@query("""
SELECT d.day, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'empty' ELSE 'value' END AS state FROM (SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE + 3, INTERVAL 1 DAY)) AS DATE) AS day FROM events) d
LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1) e ON e.day = d.day
""")
def zero_filled_days(spark: SparkSession, d: str) -> DataFrame:
    """A calendar joined with counts, empty days kept."""
    events = load(spark, d, "events")
    days = events.agg(F.explode(F.sequence(F.to_date(F.min("ts")), F.date_add(F.to_date(F.max("ts")), 3))).alias("day"))
    counts = events.where("event_type = 'signup'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("k"))
    return days.join(counts, "day", "left").select("day", F.coalesce("k", F.lit(0)).alias("n"), F.when(F.col("k").isNull(), "empty").otherwise("value").alias("state"))


@query("""
SELECT CASE WHEN r <= 8 THEN label ELSE '(other)' END AS label, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT label, n, row_number() OVER (ORDER BY first_seen, label) AS r FROM (SELECT 'u' || (user_id % 25) AS label, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1)) GROUP BY 1
""")
def bounded_labels(spark: SparkSession, d: str) -> DataFrame:
    """The first eight labels in order of arrival, the others together; labels are grouped before they are ordered."""
    by = load(spark, d, "events").groupBy(F.concat(F.lit("u"), F.col("user_id") % 25).alias("label")).agg(F.count("*").alias("n"), F.min("event_id").alias("seen"))
    early = by.orderBy("seen", "label").limit(8).select("label", F.lit(True).alias("early"))
    return by.join(early, "label", "left").groupBy(F.when(F.col("early"), F.col("label")).otherwise("(other)").alias("label")).agg(F.sum("n").alias("n"))


@query("""
SELECT coalesce(json_extract_string(props, '$.k'), '(none)') AS k, coalesce(json_extract_string(props, '$.missing'), '(none)') AS missing, count(*) AS n FROM events GROUP BY 1, 2
""")
def group_by_json(spark: SparkSession, d: str) -> DataFrame:
    key = lambda k: F.coalesce(F.get_json_object("props", f"$.{k}"), F.lit("(none)")).alias(k)
    return load(spark, d, "events").groupBy(key("k"), key("missing")).agg(F.count("*").alias("n"))


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_regions(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT source, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS done, round(100.0 * count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) / count(*), 4) AS pct FROM documents GROUP BY 1")
def coverage_progress(spark: SparkSession, d: str) -> DataFrame:
    labels = load(spark, d, "labels").select("doc_id").distinct().withColumn("done", F.lit(1))
    rows = load(spark, d, "documents").join(labels, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("done").alias("done"))
    return rows.withColumn("pct", F.round(100.0 * F.col("done") / F.col("n"), 4))
