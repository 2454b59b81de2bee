"""Plans of work with their cost, growth and repairs; samples; searches with filters, pages and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import textfns
from corpusmill.plans.ranks import interpolated
from corpusmill.plans.registry import query
from corpusmill.plans.running import running
from corpusmill.sources.tables import load

from .signals import CHANGES, SIGNALS, base_signals, moves

WORK = """
WITH sized AS (SELECT d.doc_id, source, CAST(round_even((length(text) - len(regexp_extract_all(text, '\\s'))) / 3.5::DOUBLE, 0) AS BIGINT) AS tokens, l.doc_id IS NOT NULL AS done, CASE WHEN d.doc_id % 3 = 0 THEN 'A' WHEN n_chars > 2000 THEN 'B' ELSE 'C' END AS tier
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id), todo AS (SELECT * FROM sized WHERE NOT done)
"""


def todo(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, tokens, tier of the documents without labels."""
    docs = load(spark, d, "documents").join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    tier = F.when(F.col("doc_id") % 3 == 0, "A").when(F.col("n_chars") > 2000, "B").otherwise("C")
    return docs.select("doc_id", textfns.token_estimate(F.col("text")).alias("tokens"), tier.alias("tier"))


@query(WORK + """
, fits AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY doc_id) AS k, CAST(sum(tokens) OVER (PARTITION BY tier ORDER BY doc_id) AS BIGINT) AS upto FROM todo WHERE tokens <= 3000)
SELECT t.tier, t.doc_id, t.tokens, CASE WHEN t.tokens > 3000 THEN 'oversized' WHEN upto <= 20000 AND k <= 40 THEN 'planned' ELSE 'later' END AS plan FROM todo t LEFT JOIN fits f ON f.doc_id = t.doc_id
""")
def budget_plan(spark: SparkSession, d: str) -> DataFrame:
    """Work of each tier in order until its budget of tokens or of items is full; items that are too large by themselves
    are left out before, so that they don't end it."""
    rows = todo(spark, d).withColumn("fit", F.col("tokens") <= 3000).withColumn("one", F.lit(1))
    rows = running(rows, ["tier", "fit"], ["doc_id"], {"k": "one", "upto": "tokens"})
    plan = F.when(~F.col("fit"), "oversized").when((F.col("upto") <= 20_000) & (F.col("k") <= 40), "planned").otherwise("later")
    return rows.select("tier", "doc_id", "tokens", plan.alias("plan"))


RATES = [("A", "tag", 3.0, 400), ("A", "signal", 15.0, 900), ("B", "tag", 3.0, 400), ("C", "tag", 1.0, 200)]


@query(WORK + f"""
SELECT t.tier, task, count(*) AS documents, CAST(sum(tokens + extra) AS BIGINT) AS tokens, round(sum(tokens + extra) / 1e6 * rate, 6) AS cost FROM todo t JOIN (VALUES {", ".join(str(r) for r in RATES)}) AS r(tier, task, rate, extra) ON r.tier = t.tier GROUP BY t.tier, task, rate
""")
def backfill_cost(spark: SparkSession, d: str) -> DataFrame:
    """What the work that is left costs by tier and task, at the tasks' rates."""
    rates = spark.createDataFrame(RATES, "tier string, task string, rate double, extra int")
    rows = todo(spark, d).join(F.broadcast(rates), "tier").groupBy("tier", "task", "rate").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") + F.col("extra")).alias("tokens"))
    return rows.select("tier", "task", "documents", "tokens", F.round(F.col("tokens") / 1e6 * F.col("rate"), 6).alias("cost"))


@query("""
WITH days AS (SELECT user_id % 8 AS host, CAST(ts AS DATE) AS day, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id % 8 ORDER BY CAST(ts AS DATE)) AS size FROM events GROUP BY 1, 2),
ends AS (SELECT host, min(day) AS a, max(day) AS b, arg_min(size, day) AS x, arg_max(size, day) AS y FROM days GROUP BY 1), grown AS (SELECT *, CASE WHEN b > a THEN (y - x) / date_diff('day', a, b) END AS per_day FROM ends)
SELECT host, round(per_day, 6) AS per_day, round(y + 365 * per_day, 4) AS in_a_year, list_min(list_filter([1000, 2000, 5000, 10000, 20000, 50000], lambda s: s >= (y + 365 * per_day) * 1.3)) AS size_to_buy FROM grown
""")
def capacity_plan(spark: SparkSession, d: str) -> DataFrame:
    """How a store of each host grows from its first to its last sample, what it will hold in a year, and the least size on
    offer with three tenths to spare."""
    daily = load(spark, d, "events").groupBy((F.col("user_id") % 8).alias("host"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    size = F.sum("n").over(Window.partitionBy("host").orderBy("day"))
    ends = daily.withColumn("size", size).groupBy("host").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.min_by("size", "day").alias("x"), F.max_by("size", "day").alias("y"))
    rows = ends.withColumn("p", F.when(F.col("b") > F.col("a"), (F.col("y") - F.col("x")) / F.datediff("b", "a"))).withColumn("then", F.col("y") + 365 * F.col("p"))
    steps = F.filter(F.array(*[F.lit(s) for s in (1000, 2000, 5000, 10_000, 20_000, 50_000)]), lambda s: s >= F.col("then") * 1.3)
    return rows.select("host", F.round("p", 6).alias("per_day"), F.round("then", 4).alias("in_a_year"), F.array_min(steps).alias("size_to_buy"))


@query("""
WITH docs AS (SELECT doc_id, lang, source, n_chars % 4 AS quarter FROM documents), picked AS (SELECT lang, quarter, min(doc_id) AS a FROM docs GROUP BY 1, 2)
SELECT p.lang, p.quarter, a, min(d.doc_id) AS b FROM picked p JOIN docs s ON s.doc_id = p.a JOIN docs d ON d.lang = p.lang AND d.quarter = p.quarter AND d.source <> s.source GROUP BY 1, 2, 3
""")
def comparison_pairs(spark: SparkSession, d: str) -> DataFrame:
    """For each language and quarter a document and another one of a different source to compare it with: the first, and
    the first of each source after it, so that no pairs are formed within a group."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 4).alias("quarter"))
    firsts = docs.groupBy("lang", "quarter", "source").agg(F.min("doc_id").alias("x"))
    order = F.row_number().over(Window.partitionBy("lang", "quarter").orderBy("x"))
    two = firsts.withColumn("n", order).where("n <= 2").groupBy("lang", "quarter").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("k"))
    return two.where("k = 2").select("lang", "quarter", "a", "b")


@query("""
SELECT d.doc_id, l.quality IS NULL AS no_tag, NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id) AS no_vector, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 400)) > 0 AS long_lines
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND (l.quality IS NULL OR NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id))
""")
def pending_assets(spark: SparkSession, d: str) -> DataFrame:
    """Documents that lack something derived: a tag, a vector; blocked ones are not asked for."""
    labels = load(spark, d, "labels")
    docs = load(spark, d, "documents").join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("v")).distinct()
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id", "left").join(vectors, "doc_id", "left")
    long = F.exists(F.split("text", "\n"), lambda x: F.length(x) > 400)
    return rows.select("doc_id", F.col("quality").isNull().alias("no_tag"), F.col("v").isNull().alias("no_vector"), long.alias("long_lines")).where("no_tag or no_vector")


def allows(market: Column, kinds: Column, allowed_markets: list[str], allowed_kinds: list[str] | None) -> Column:
    """Whether an allow-list lets a row through: its market must be listed; of kinds, an array, one must be if any are."""
    ok = market.isin(allowed_markets)
    return ok & F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in allowed_kinds])) if allowed_kinds is not None else ok


@query("SELECT p_partkey, list_has_any(string_split(p_type, ' '), ['STEEL', 'TIN']) AS by_kind FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND list_has_any(string_split(p_type, ' '), ['STEEL', 'TIN', 'LARGE'])")
def entitled_parts(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.split("p_type", " ")
    rows = load(spark, d, "part").where(allows(F.col("p_brand"), kinds, ["Brand#11", "Brand#22", "Brand#33"], ["STEEL", "TIN", "LARGE"]))
    return rows.select("p_partkey", F.arrays_overlap(kinds, F.array(F.lit("STEEL"), F.lit("TIN"))).alias("by_kind"))


@query("SELECT p_partkey, p_name, count(*) OVER () AS total FROM part WHERE p_name ILIKE '%1%' OR p_type ILIKE '%steel%' OR p_brand ILIKE '%22%' ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 20 OFFSET 40")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    """The third page of a search in several columns, with the number of all hits."""
    hits = load(spark, d, "part").where(F.col("p_name").ilike("%1%") | F.col("p_type").ilike("%steel%") | F.col("p_brand").ilike("%22%"))
    page = hits.orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey").offset(40).limit(20)
    return page.crossJoin(hits.agg(F.count("*").alias("total"))).select("p_partkey", "p_name", "total")


BINS = """
WITH five AS (SELECT user_id % 5 AS host, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, count(*) AS n, sum(value) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2), cut AS (SELECT max(ts) - INTERVAL 2 DAY AS since FROM events)
"""


@query(BINS + """
, joined AS (SELECT host, bucket, n, total, low, high FROM five, cut WHERE bucket < date_trunc('hour', since) UNION ALL SELECT user_id % 5, ts, 1, value, value, value FROM events, cut WHERE ts >= date_trunc('hour', since))
SELECT host, date_trunc('hour', bucket) AS hour, CAST(sum(n) AS BIGINT) AS n, round(sum(total) / sum(n), 6) AS mean, min(low) AS low, max(high) AS high FROM joined GROUP BY 1, 2
""")
def raw_and_finer(spark: SparkSession, d: str) -> DataFrame:
    """Hours from five-minute buckets where these are all that is left, and from raw rows after that."""
    events = load(spark, d, "events").select((F.col("user_id") % 5).alias("host"), "ts", "value")
    cut = events.agg(F.date_trunc("hour", F.max("ts") - F.expr("interval 2 days")).cast("timestamp_ntz").alias("since"))
    five = events.groupBy("host", F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    five = five.select("host", F.col("w.start").cast("timestamp_ntz").alias("at"), "n", "total", "low", "high").crossJoin(F.broadcast(cut)).where("at < since").drop("since")
    raw = events.crossJoin(F.broadcast(cut)).where("ts >= since").select("host", F.col("ts").alias("at"), F.lit(1).cast("long").alias("n"), F.col("value").alias("total"), F.col("value").alias("low"), F.col("value").alias("high"))
    rows = five.unionByName(raw).groupBy("host", F.date_trunc("hour", "at").cast("timestamp_ntz").alias("hour"))
    return rows.agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))


MERGED = """
WITH part AS (SELECT user_id % 5 AS host, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, event_id % 10 = 0 AS late, count(*) AS n, sum(value) AS total, min(value) AS low, max(value) AS high, min(ts) AS first_at, max(ts) AS last_at,
  arg_max(value, struct_pack(a := ts, b := event_id)) AS last, arg_min(event_type, struct_pack(a := ts, b := event_id)) AS first_state, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS last_state FROM events GROUP BY 1, 2, 3)
"""


@query(MERGED + """
SELECT host, bucket, CAST(sum(n) AS BIGINT) AS n, round(sum(total) / sum(n), 6) AS mean, min(low) AS low, max(high) AS high, arg_max(last, struct_pack(a := last_at, b := late)) AS last,
  CAST(sum((first_state <> last_state)::INT) + (count(*) = 2 AND arg_min(last_state, struct_pack(a := last_at, b := late)) <> arg_max(first_state, struct_pack(a := last_at, b := late)))::INT AS BIGINT) AS least_changes FROM part GROUP BY 1, 2
""")
def merge_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of late rows merged into those that exist from the two buckets alone: weighted mean, extremes, the later one's
    last value, and the changes of state within each and at the seam."""
    at = F.struct("ts", "event_id")
    rows = load(spark, d, "events").groupBy((F.col("user_id") % 5).alias("host"), F.window("ts", "5 minutes").alias("w"), (F.col("event_id") % 10 == 0).alias("late")).agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.max("ts").alias("last_at"), F.max_by("value", at).alias("last"),
        F.min_by("event_type", at).alias("first_state"), F.max_by("event_type", at).alias("last_state"),
    )
    order = F.struct("last_at", "late")
    seam = (F.count("*") == 2) & (F.min_by("last_state", order) != F.max_by("first_state", order))
    changes = F.count_if(F.col("first_state") != F.col("last_state")) + seam.cast("int")
    merged = rows.groupBy("host", F.col("w.start").cast("timestamp_ntz").alias("bucket"))
    return merged.agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"), F.max_by("last", order).alias("last"), changes.alias("least_changes"))


@query("""
SELECT host, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most, round(avg(value), 6) AS mean FROM (SELECT user_id % 5 AS host, value FROM events) GROUP BY 1
""")
def value_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated quantiles from counted values: no group holds its rows, only running counts of its different values."""
    rows = load(spark, d, "events").select((F.col("user_id") % 5).alias("host"), "value")
    shares = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    sums = rows.groupBy("host").agg(F.count("*").alias("n"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))
    return sums.join(interpolated(rows, ["host"], "value", shares), "host").select("host", "n", *[F.round(p, 6).alias(p) for p in shares], "most", "mean")


@query("""
WITH kinds AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, user_id % 5 AS host, event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1, 2, 3)
SELECT week, host, CAST(sum(n) AS BIGINT) AS incidents, list(event_type ORDER BY n DESC, event_type)[1:2] AS reasons FROM kinds GROUP BY 1, 2
""")
def incident_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Incidents of a week and host, and their two most frequent reasons."""
    kinds = load(spark, d, "events").where("event_type <> 'view'").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), (F.col("user_id") % 5).alias("host"), "event_type").agg(F.count("*").alias("n"))
    top = F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "event_type"))), lambda x: x["event_type"]), 1, 2)
    return kinds.groupBy("week", "host").agg(F.sum("n").alias("incidents"), top.alias("reasons"))


@query("""
WITH days AS (SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS DATE) AS day FROM events), rolled AS (SELECT DISTINCT ts::DATE AS day FROM events WHERE event_type = 'purchase'), n AS (SELECT ts::DATE AS day, count(*) AS n FROM events WHERE event_type = 'error' AND value > 95 GROUP BY 1)
SELECT d.day, CASE WHEN extract(day FROM d.day) % 6 = 0 OR r.day IS NULL THEN NULL ELSE coalesce(n, 0) END AS n FROM days d LEFT JOIN rolled r ON r.day = d.day LEFT JOIN n ON n.day = d.day
""")
def three_state_days(spark: SparkSession, d: str) -> DataFrame:
    """A value, zero, or null for a day that is not rolled up yet."""
    events = load(spark, d, "events")
    days = events.agg(F.explode(F.sequence(F.to_date(F.min("ts")), F.to_date(F.max("ts")))).alias("day"))
    rolled = events.where("event_type = 'purchase'").select(F.to_date("ts").alias("day"), F.lit(True).alias("rolled")).distinct()
    counts = events.where("event_type = 'error' and value > 95").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("k"))
    rows = days.join(rolled, "day", "left").join(counts, "day", "left")
    return rows.select("day", F.when((F.dayofmonth("day") % 6 != 0) & F.col("rolled").isNotNull(), F.coalesce("k", F.lit(0))).alias("n"))


@query("SELECT o_orderkey, CASE WHEN day IS NULL THEN 0 ELSE round(pow(0.5, greatest(0, date_diff('day', day, DATE '1998-06-01')) / 90.0), 9) END AS recency FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate::DATE END AS day FROM orders)")
def recency_of_all(spark: SparkSession, d: str) -> DataFrame:
    """Recency with half-life: 1 for what is new or yet to come, 0 for what has no date."""
    day = F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate"))
    age = F.greatest(F.lit(0), F.datediff(F.lit("1998-06-01").cast("date"), day))
    return load(spark, d, "orders").select("o_orderkey", F.coalesce(F.when(day.isNotNull(), F.round(F.pow(F.lit(0.5), age / 90.0), 9)), F.lit(0.0)).alias("recency"))


@query("""
WITH hours AS (SELECT user_id % 5 AS host, date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1, 2), counters AS (SELECT *, sum(n) OVER (PARTITION BY host ORDER BY hour) AS all_, sum(bad) OVER (PARTITION BY host ORDER BY hour) AS bad_ FROM hours),
days AS (SELECT host, CAST(hour AS DATE) AS day, arg_max(all_, hour) AS all_, arg_max(bad_, hour) AS bad_ FROM counters GROUP BY 1, 2), prev AS (SELECT *, lag(all_) OVER (PARTITION BY host ORDER BY day) AS pa, lag(bad_) OVER (PARTITION BY host ORDER BY day) AS pb FROM days)
SELECT host, day, CAST(CASE WHEN all_ >= pa THEN all_ - pa END AS BIGINT) AS calls, round(CASE WHEN all_ > pa THEN (bad_ - pb) / (all_ - pa) END, 6) AS bad_share FROM prev
""")
def counter_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counters, their last state of a day, and from one day to the next the rate and the ratio of two rates."""
    hours = load(spark, d, "events").groupBy((F.col("user_id") % 5).alias("host"), F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    of = Window.partitionBy("host").orderBy("hour")
    counters = hours.select("host", "hour", F.sum("n").over(of).alias("a"), F.sum("bad").over(of).alias("b"))
    days = counters.groupBy("host", F.to_date("hour").alias("day")).agg(F.max_by("a", "hour").alias("a"), F.max_by("b", "hour").alias("b"))
    by = Window.partitionBy("host").orderBy("day")
    rows = days.withColumn("pa", F.lag("a").over(by)).withColumn("pb", F.lag("b").over(by))
    calls = F.when(F.col("a") >= F.col("pa"), F.col("a") - F.col("pa"))
    return rows.select("host", "day", calls.alias("calls"), F.round(F.when(F.col("a") > F.col("pa"), (F.col("b") - F.col("pb")) / (F.col("a") - F.col("pa"))), 6).alias("bad_share"))


@query(CHANGES + """
SELECT instrument, broker, signal_date, field, old, new, CASE WHEN new > old THEN 'up' ELSE 'down' END AS direction FROM (
  SELECT instrument, broker, signal_date, 'rating' AS field, CAST(prev_rating AS DOUBLE) AS old, CAST(rating AS DOUBLE) AS new, signal_date FROM moved UNION ALL SELECT instrument, broker, signal_date, 'target', prev_target, target, signal_date FROM moved WHERE prev_currency = currency)
WHERE old <> new AND (field = 'target' OR broker % 3 <> 0)
""".replace("AS new, signal_date FROM moved", "AS new FROM moved").replace("target, signal_date FROM moved", "target FROM moved"))
def field_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes with the old and the new value; a rating counts only with its evidence, which every third broker lacks."""
    rows = moves(base_signals(spark, d))
    double = lambda c: F.col(c).cast("double")
    changes = F.array(
        F.struct(F.lit("rating").alias("field"), F.when(F.col("broker") % 3 != 0, double("prev_rating")).alias("old"), double("rating").alias("new")),
        F.struct(F.lit("target").alias("field"), F.when(F.col("prev_currency") == F.col("currency"), F.col("prev_target")).alias("old"), F.col("target").alias("new")),
    )
    told = rows.select("instrument", "broker", "signal_date", F.explode(changes).alias("c")).select("instrument", "broker", "signal_date", "c.*").where("old <> new")
    return told.withColumn("direction", F.when(F.col("new") > F.col("old"), "up").otherwise("down"))


@query(SIGNALS + """
, sig AS (SELECT instrument, count(*) AS signals, count(DISTINCT broker) AS brokers, max(signal_date) AS latest FROM signals GROUP BY 1), rep AS (SELECT p_brand AS instrument, count(*) AS parts, any_value(left(p_brand, 7)) AS family FROM part GROUP BY 1),
cat AS (SELECT s.*, parts, family FROM sig s JOIN rep USING (instrument) WHERE s.brokers >= 2)
SELECT instrument, family, signals, brokers, latest, count(*) OVER (PARTITION BY family) AS family_size, CAST(row_number() OVER (ORDER BY signals DESC, instrument) AS INTEGER) AS place FROM cat
""")
def instrument_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Instruments with at least two brokers in order of their signals, each with the facet count of its family."""
    sig = base_signals(spark, d).groupBy("instrument").agg(F.count("*").alias("signals"), F.countDistinct("broker").alias("brokers"), F.max("signal_date").alias("latest"))
    rep = load(spark, d, "part").groupBy(F.col("p_brand").alias("instrument")).agg(F.count("*").alias("parts"))
    cat = sig.join(rep, "instrument").where("brokers >= 2").withColumn("family", F.substring("instrument", 1, 7))
    sizes = cat.groupBy("family").agg(F.count("*").alias("family_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("signals"), "instrument"))  # one row for each instrument
    return cat.join(sizes, "family").select("instrument", "family", "signals", "brokers", "latest", "family_size", place.alias("place"))


@query("""
WITH cited AS (SELECT ts::DATE AS day, user_id, unnest([event_id % 50, event_id % 7, event_id % 50]) AS report FROM events), hits AS (SELECT day, 'report' AS dimension, CAST(report AS VARCHAR) AS entity, user_id FROM cited UNION ALL SELECT day, 'market', 'm' || report % 4, user_id FROM cited)
SELECT day, dimension, entity, count(*) AS hits, count(DISTINCT user_id) AS users FROM hits GROUP BY 1, 2, 3
""")
def hot_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Reports that answers cite, and the markets of these, by day."""
    cited = load(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id", F.explode(F.array(F.col("event_id") % 50, F.col("event_id") % 7, F.col("event_id") % 50)).alias("report"))
    both = F.explode(F.array(F.struct(F.lit("report").alias("dimension"), F.col("report").cast("string").alias("entity")), F.struct(F.lit("market").alias("dimension"), F.concat(F.lit("m"), (F.col("report") % 4).cast("string")).alias("entity")))).alias("x")
    return cited.select("day", "user_id", both).groupBy("day", "x.dimension", "x.entity").agg(F.count("*").alias("hits"), F.countDistinct("user_id").alias("users"))


@query("""
WITH fixed AS (SELECT * FROM (VALUES ('click'), ('view'), ('error'), ('export')) AS t(kind)), n AS (SELECT event_type AS kind, ts::DATE AS day, count(*) AS hits, count(DISTINCT user_id) AS users FROM events WHERE value > 97 GROUP BY 1, 2), days AS (SELECT DISTINCT ts::DATE AS day FROM events)
SELECT d.day, f.kind, CASE WHEN coalesce(users, 0) = 0 THEN 0 WHEN users >= 3 THEN hits END AS hits, coalesce(users, 0) BETWEEN 1 AND 2 AS hidden FROM days d, fixed f LEFT JOIN n ON n.kind = f.kind AND n.day = d.day
""")
def top_fixed_vocab(spark: SparkSession, d: str) -> DataFrame:
    """All words of a fixed vocabulary for each day: nothing used is told as 0, and few users' use is hidden."""
    events = load(spark, d, "events")
    words = F.explode(F.array(*[F.lit(k) for k in ("click", "view", "error", "export")])).alias("kind")
    days = events.select(F.to_date("ts").alias("day")).distinct().select("day", words)
    counts = events.where("value > 97").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("kind")).agg(F.count("*").alias("k"), F.countDistinct("user_id").alias("users"))
    rows = days.join(counts, ["day", "kind"], "left")
    return rows.select("day", "kind", F.when(F.col("users").isNull(), 0).when(F.col("users") >= 3, F.col("k")).alias("hits"), F.coalesce(F.col("users") < 3, F.lit(False)).alias("hidden"))


@query("""
WITH claims AS (SELECT a.conv_id, a.turn, unnest(list_distinct(regexp_extract_all(lower(a.text), '[a-z]{5,}'))) AS word FROM conversations a WHERE role = 'assistant'), said AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM conversations WHERE role = 'user')
SELECT c.conv_id, count(*) AS claims, count(s.word) AS supported, round(count(s.word) / count(*), 6) AS faithfulness FROM claims c LEFT JOIN said s ON s.conv_id = c.conv_id AND s.word = c.word GROUP BY 1
""")
def claim_support(spark: SparkSession, d: str) -> DataFrame:
    """How much of what an assistant says stands in what it was given: its longer words, found in the user's turns."""
    rows = load(spark, d, "conversations")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)))
    claims = rows.where("role = 'assistant'").select("conv_id", "turn", F.explode(words).alias("word"))
    given = rows.where("role = 'user'").select("conv_id", F.explode(words).alias("word")).distinct().withColumn("ok", F.lit(1))
    told = claims.join(given, ["conv_id", "word"], "left").groupBy("conv_id").agg(F.count("*").alias("claims"), F.count("ok").alias("supported"))
    return told.withColumn("faithfulness", F.round(F.col("supported") / F.col("claims"), 6))


@query("""
WITH a AS (SELECT user_id % 50 AS item, avg(value) AS score FROM events WHERE event_id % 2 = 0 AND user_id % 50 <> 7 GROUP BY 1), b AS (SELECT user_id % 50 AS item, avg(value) AS score FROM events WHERE event_id % 2 = 1 AND user_id % 50 <> 9 GROUP BY 1)
SELECT coalesce(a.item, b.item) AS item, CASE WHEN a.item IS NULL THEN 'only new' WHEN b.item IS NULL THEN 'only old' WHEN abs(b.score - a.score) <= greatest(2.0, 0.02 * a.score) THEN 'same' WHEN b.score > a.score THEN 'better' ELSE 'worse' END AS verdict, round(b.score - a.score, 6) AS delta FROM a FULL OUTER JOIN b ON a.item = b.item
""")
def compare_judged(spark: SparkSession, d: str) -> DataFrame:
    """Two judged runs item by item; only items that both judged are compared, the others are told apart."""
    events = load(spark, d, "events").withColumn("item", F.col("user_id") % 50)
    run = lambda odd, gone, name: events.where((F.col("event_id") % 2 == odd) & (F.col("item") != gone)).groupBy("item").agg(F.avg("value").alias(name))
    delta = F.col("b") - F.col("a")
    verdict = F.when(F.col("a").isNull(), "only new").when(F.col("b").isNull(), "only old").when(F.abs(delta) <= F.greatest(F.lit(2.0), 0.02 * F.col("a")), "same").when(delta > 0, "better").otherwise("worse")
    return run(0, 7, "a").join(run(1, 9, "b"), "item", "full_outer").select("item", verdict.alias("verdict"), F.round(delta, 6).alias("delta"))


@query("""
WITH want AS (SELECT conv_id, list_sort(list(turn)) AS w FROM conversations GROUP BY 1), got AS (SELECT conv_id, turn + CASE WHEN conv_id % 6 = 0 THEN 1 ELSE 0 END AS i, CASE turn % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'unsupported' END AS verdict FROM conversations),
lists AS (SELECT conv_id, list_sort(list(i)) AS g, count(*) FILTER (coalesce(verdict, 'unsupported') = 'supported') AS supported, count(*) AS n FROM got GROUP BY 1)
SELECT w.conv_id, w.w = l.g AS valid, CASE WHEN w.w = l.g THEN round(supported / n, 6) END AS score FROM want w JOIN lists l USING (conv_id)
""")
def judge_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a judge: the indices must be just those asked for, each once; a verdict left out counts as unsupported."""
    rows = load(spark, d, "conversations")
    given = rows.select("conv_id", "turn", (F.col("turn") + F.when(F.col("conv_id") % 6 == 0, 1).otherwise(0)).alias("i"), (F.col("turn") % 3 == 0).alias("ok"))
    lists = given.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("w"), F.array_sort(F.collect_list("i")).alias("g"), F.count_if("ok").alias("s"), F.count("*").alias("n"))
    valid = F.col("w") == F.col("g")
    return lists.select("conv_id", valid.alias("valid"), F.when(valid, F.round(F.col("s") / F.col("n"), 6)).alias("score"))


@query("""
WITH hits AS (SELECT user_id % 40 AS probe, event_id, ts, value, row_number() OVER (PARTITION BY user_id % 40 ORDER BY value DESC, event_id) AS rn FROM events), now AS (SELECT max(ts)::DATE AS day FROM events),
cases AS (SELECT probe, count(*) FILTER (event_id % 3 = 0) AS found, min(date_diff('day', ts::DATE, day)) AS newest FROM hits, now WHERE rn <= 10 GROUP BY 1)
SELECT count(*) AS cases, round(avg(CASE WHEN found >= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(found / 10.0), 6) AS mean_precision, round(avg(CASE WHEN newest <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recency_pass FROM cases
""")
def retrieval_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases of a retrieval test: hit, precision among ten, and whether something recent is among them."""
    events = load(spark, d, "events")
    rn = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("value"), "event_id"))
    top = events.withColumn("probe", F.col("user_id") % 40).withColumn("rn", rn).where("rn <= 10").crossJoin(F.broadcast(events.agg(F.to_date(F.max("ts")).alias("day"))))
    cases = top.groupBy("probe").agg(F.count_if(F.col("event_id") % 3 == 0).alias("found"), F.min(F.datediff("day", F.to_date("ts"))).alias("newest"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return cases.agg(F.count("*").alias("cases"), share(F.col("found") >= 1).alias("hit_rate"), F.round(F.avg(F.col("found") / 10.0), 6).alias("mean_precision"), share(F.col("newest") <= 3).alias("recency_pass"))


@query("""
SELECT l_orderkey, count(*) AS fields, count(*) FILTER (abs(got - want) <= 0.01 * greatest(abs(got), abs(want))) AS right_, round(count(*) FILTER (abs(got - want) <= 0.01 * greatest(abs(got), abs(want))) / count(*), 6) AS accuracy FROM (
  SELECT l_orderkey, l_extendedprice AS want, CASE WHEN l_linenumber % 4 = 0 THEN l_extendedprice * 1.02 ELSE l_extendedprice * 1.005 END AS got FROM lineitem) GROUP BY 1
""")
def field_scores(spark: SparkSession, d: str) -> DataFrame:
    """Extracted numbers against the true ones, right within one percent."""
    want = F.col("l_extendedprice")
    got = F.when(F.col("l_linenumber") % 4 == 0, want * 1.02).otherwise(want * 1.005)
    close = F.abs(got - want) <= 0.01 * F.greatest(F.abs(got), F.abs(want))
    rows = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("fields"), F.count_if(close).alias("right_"))
    return rows.withColumn("accuracy", F.round(F.col("right_") / F.col("fields"), 6))


@query("""
WITH last AS (SELECT event_type AS feed, max(ts) AS at_ FROM events GROUP BY 1), ages AS (SELECT feed, date_diff('hour', at_, (SELECT max(ts) FROM events)) AS hours FROM last), gates AS (SELECT * FROM (VALUES ('click', 'view'), ('purchase', 'click'), ('error', 'error')) AS t(feed, needs))
SELECT a.feed, a.hours, CASE WHEN g.needs <> a.feed AND u.hours >= 1 THEN 'waiting' WHEN a.hours >= 2 THEN 'fail' WHEN a.hours >= 1 THEN 'warn' ELSE 'ok' END AS state FROM ages a LEFT JOIN gates g ON g.feed = a.feed LEFT JOIN ages u ON u.feed = g.needs
""")
def gated_freshness(spark: SparkSession, d: str) -> DataFrame:
    """How old a feed is; one whose source is late waits instead of failing."""
    last = load(spark, d, "events").groupBy(F.col("event_type").alias("feed")).agg(F.max("ts").alias("seen"))
    end = last.agg(F.max("seen").alias("end"))
    hour = lambda c: F.unix_seconds(F.date_trunc("hour", c).cast("timestamp"))
    ages = last.crossJoin(F.broadcast(end)).select("feed", ((hour("end") - hour("seen")) / 3600).cast("long").alias("hours"))
    gates = spark.createDataFrame([("click", "view"), ("purchase", "click"), ("error", "error")], "feed string, needs string")
    up = ages.select(F.col("feed").alias("needs"), F.col("hours").alias("up"))
    rows = ages.join(F.broadcast(gates), "feed", "left").join(up, "needs", "left")
    waits = F.coalesce((F.col("needs") != F.col("feed")) & (F.col("up") >= 1), F.lit(False))
    return rows.select("feed", "hours", F.when(waits, "waiting").when(F.col("hours") >= 2, "fail").when(F.col("hours") >= 1, "warn").otherwise("ok").alias("state"))
