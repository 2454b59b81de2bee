"""Consensus analytics over dated ratings and targets of (instrument, broker).

The signals are read from the order tables: instrument is a part's brand, broker the supplier, the date the order's,
the rating the order's priority from 2 (first) to -2, the target the highest unit price, the currency the supplier's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.frames import checkpointed, small_or_not
from corpusmill.plans.ranks import interpolated
from corpusmill.plans.registry import query
from corpusmill.sources.tables import load

SIGNALS = """
WITH signals AS (
  SELECT p_brand AS instrument, l_suppkey AS broker, CAST(o_orderdate AS DATE) AS signal_date,
    max(3 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS rating, max(l_extendedprice / l_quantity) AS target, max(s_nationkey % 3) AS currency
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)
"""
#: As above, with the latest signal of each broker within 180 days of the instrument's last one.
LATEST = SIGNALS + """, latest AS (
  SELECT * EXCLUDE (n, last_date) FROM (
    SELECT *, row_number() OVER (PARTITION BY instrument, broker ORDER BY signal_date DESC) AS n, max(signal_date) OVER (PARTITION BY instrument) AS last_date FROM signals)
  WHERE n = 1 AND date_diff('day', signal_date, last_date) <= 180)
"""
CHANGES = SIGNALS + """, moved AS (
  SELECT *, lag(rating) OVER w AS prev_rating, lag(target) OVER w AS prev_target, lag(currency) OVER w AS prev_currency FROM signals WINDOW w AS (PARTITION BY instrument, broker ORDER BY signal_date))
"""


def base_signals(spark: SparkSession, d: str) -> DataFrame:
    """instrument, broker, signal_date, rating, target, currency: one row for each of the first three. The lines are shuffled
    with what is needed of them; the currency is the broker's and joins the grouped rows."""
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    target = F.when(quantity == 0, price * float("inf")).otherwise(price / quantity)
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("broker"), target.alias("target"))
    parts = load(spark, d, "part").select("p_partkey", F.col("p_brand").alias("instrument"))
    orders = load(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("signal_date"), F.substring("o_orderpriority", 1, 1).alias("priority"))
    lines = lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = lines.groupBy("instrument", "broker", "signal_date").agg(F.max(3 - F.col("priority").cast("int")).alias("rating"), F.max("target").alias("target"))
    brokers = load(spark, d, "supplier").groupBy(F.col("s_suppkey").alias("broker")).agg(F.max(F.col("s_nationkey") % 3).alias("currency"))
    return rows.join(brokers, "broker").select("instrument", "broker", "signal_date", "rating", "target", "currency")


def latest_per_broker(signals: DataFrame, days: int = 180) -> DataFrame:
    """The newest signal of each broker, if it is within so many days of the instrument's newest. The newest signals are
    computed once, however often the result is read."""
    columns = [c for c in signals.columns if c not in ("instrument", "broker")]
    newest = signals.groupBy("instrument", "broker").agg(F.max_by(F.struct(*columns), "signal_date").alias("s")).select("instrument", "broker", "s.*")
    return within(checkpointed(newest), days)


def within(newest: DataFrame, days: int = 180) -> DataFrame:
    """Rows whose signal_date is within so many days of the instrument's newest. The newest dates come from grouped maxima,
    so that no instrument is one window. newest is read twice."""
    anchor = small_or_not(newest.groupBy(F.col("instrument").alias("_of")).agg(F.max("signal_date").alias("last_date")))
    return newest.join(anchor, F.col("instrument").eqNullSafe(F.col("_of"))).where(F.datediff("last_date", "signal_date") <= days).drop("_of", "last_date")


def median_rating(rating: Column) -> Column:
    """Ordinal median, halves rounded up."""
    return F.floor(F.percentile(rating, F.lit(0.5)) + 0.5).cast("int")


def pct_change(now: Column, before: Column) -> Column:
    """Change in percent of the absolute earlier value; null if that is 0."""
    return F.when(before != 0, (now - before) / F.abs(before) * 100)


def direction(now: Column, before: Column) -> Column:
    return F.when(before.isNull() | now.isNull(), "none").when(now > before, "up").when(now < before, "down").otherwise("flat")


def moves(signals: DataFrame) -> DataFrame:
    """signals with the previous rating, target and currency of the same instrument and broker."""
    w = Window.partitionBy("instrument", "broker").orderBy("signal_date")
    return signals.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in ("rating", "target", "currency")])


@query(LATEST + "SELECT instrument, broker, signal_date, rating, target, currency FROM latest")
def consensus_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_per_broker(base_signals(spark, d)).select("instrument", "broker", "signal_date", "rating", "target", "currency")


@query(LATEST + """
SELECT instrument, count(*) AS brokers, CAST(sum(CASE WHEN rating > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, CAST(sum(CASE WHEN rating = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neutral,
  CAST(sum(CASE WHEN rating < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative, CAST(floor(quantile_cont(rating, 0.5) + 0.5) AS INTEGER) AS median_rating
FROM latest GROUP BY instrument
""")
def consensus_rating(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("rating")
    return latest_per_broker(base_signals(spark, d)).groupBy("instrument").agg(
        F.count("*").alias("brokers"), F.count_if(r > 0).alias("positive"), F.count_if(r == 0).alias("neutral"), F.count_if(r < 0).alias("negative"), median_rating(r).alias("median_rating"),
    )


@query(LATEST + """
SELECT instrument, currency, brokers, low, q1, median, q3, high FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY brokers DESC, currency) AS n FROM (
    SELECT instrument, currency, count(*) AS brokers, min(target) AS low, round(quantile_cont(target, 0.25), 6) AS q1, round(quantile_cont(target, 0.5), 6) AS median, round(quantile_cont(target, 0.75), 6) AS q3, max(target) AS high
    FROM latest GROUP BY instrument, currency)) WHERE n = 1
""")
def consensus_target(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of the targets in each instrument's primary currency, that of most brokers."""
    latest = checkpointed(latest_per_broker(base_signals(spark, d)).select("instrument", "currency", "target"))
    by = latest.groupBy("instrument", "currency").agg(F.count("*").alias("brokers"), F.min("target").alias("low"), F.max("target").alias("high"))
    first = Window.partitionBy("instrument").orderBy(F.desc("brokers"), "currency")
    rows = by.withColumn("n", F.row_number().over(first)).where("n = 1")
    q = interpolated(latest, ["instrument", "currency"], "target", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    rows = rows.join(q, ["instrument", "currency"], "left")
    return rows.select("instrument", "currency", "brokers", "low", *[F.round(k, 6).alias(k) for k in ("q1", "median", "q3")], "high")


@query(CHANGES + """, net AS (
  SELECT instrument, sum(CASE WHEN rating > prev_rating THEN 1 ELSE 0 END) AS up, sum(CASE WHEN rating < prev_rating THEN 1 ELSE 0 END) AS down, count(prev_rating) AS n FROM moved GROUP BY instrument)
SELECT instrument, CAST(up AS BIGINT) AS up, CAST(down AS BIGINT) AS down, CASE WHEN n < 2 THEN 'insufficient' WHEN up + down = 0 THEN 'stable'
  WHEN least(up, down) >= 0.4 * (up + down) THEN 'diverging' WHEN up > down THEN 'strengthening' ELSE 'weakening' END AS label FROM net
""")
def dimension_label(spark: SparkSession, d: str) -> DataFrame:
    net = moves(base_signals(spark, d)).groupBy("instrument").agg(
        F.count_if(F.col("rating") > F.col("prev_rating")).alias("up"), F.count_if(F.col("rating") < F.col("prev_rating")).alias("down"), F.count("prev_rating").alias("n")
    )
    total = F.col("up") + F.col("down")
    label = F.when(F.col("n") < 2, "insufficient").when(total == 0, "stable").when(F.least("up", "down") >= 0.4 * total, "diverging").when(F.col("up") > F.col("down"), "strengthening")
    return net.select("instrument", "up", "down", label.otherwise("weakening").alias("label"))


@query(CHANGES + """
SELECT instrument, broker, signal_date, field, direction FROM (
  SELECT instrument, broker, signal_date, 'rating' AS field, CASE WHEN rating > prev_rating THEN 'up' WHEN rating < prev_rating THEN 'down' ELSE 'flat' END AS direction FROM moved WHERE prev_rating IS NOT NULL
  UNION ALL SELECT instrument, broker, signal_date, 'target', CASE WHEN target > prev_target THEN 'up' WHEN target < prev_target THEN 'down' ELSE 'flat' END FROM moved WHERE prev_currency = currency)
WHERE direction <> 'flat'
""")
def events_material(spark: SparkSession, d: str) -> DataFrame:
    """Changes that can be compared and have a direction, one row for each field."""
    rows = moves(base_signals(spark, d))
    target = F.when(F.col("prev_currency") == F.col("currency"), F.col("prev_target"))
    changes = F.array(F.struct(F.lit("rating").alias("field"), direction(F.col("rating"), F.col("prev_rating")).alias("direction")), F.struct(F.lit("target").alias("field"), direction(F.col("target"), target).alias("direction")))
    return rows.select("instrument", "broker", "signal_date", F.explode(changes).alias("c")).select("instrument", "broker", "signal_date", "c.*").where("direction in ('up', 'down')")


@query(SIGNALS + """
SELECT instrument, count(*) AS n_signals, count(DISTINCT broker) AS n_brokers, max(signal_date) AS latest, min(signal_date) AS earliest, arg_max(rating, struct_pack(a := signal_date, b := broker)) AS last_rating,
  CASE WHEN count(DISTINCT broker) >= 80 THEN 'broad' WHEN count(DISTINCT broker) >= 3 THEN 'covered' ELSE 'thin' END AS coverage
FROM signals GROUP BY instrument
""")
def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Instruments with their coverage."""
    rows = base_signals(spark, d).groupBy("instrument").agg(
        F.count("*").alias("n_signals"), F.countDistinct("broker").alias("n_brokers"), F.max("signal_date").alias("latest"), F.min("signal_date").alias("earliest"),
        F.max_by("rating", F.struct("signal_date", "broker")).alias("last_rating"),
    )
    return rows.withColumn("coverage", F.when(F.col("n_brokers") >= 80, "broad").when(F.col("n_brokers") >= 3, "covered").otherwise("thin"))


@query(CHANGES + "SELECT instrument, broker, signal_date, rating, prev_rating FROM moved WHERE rating <> prev_rating ORDER BY signal_date DESC, instrument, broker LIMIT 100")
def recent_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = moves(base_signals(spark, d)).where("rating <> prev_rating").select("instrument", "broker", "signal_date", "rating", "prev_rating")
    return rows.orderBy(F.desc("signal_date"), "instrument", "broker").limit(100)


@query(CHANGES + """
SELECT signal_date AS day, count(*) AS n, count(DISTINCT instrument) AS instruments, CAST(sum(CASE WHEN rating > prev_rating THEN 1 ELSE 0 END) AS BIGINT) AS upgrades,
  CAST(sum(CASE WHEN rating < prev_rating THEN 1 ELSE 0 END) AS BIGINT) AS downgrades, list_sort(list(DISTINCT currency)) AS currencies FROM moved GROUP BY signal_date
""")
def brief_mix(spark: SparkSession, d: str) -> DataFrame:
    """What a day's brief is made from; changes look back beyond the day."""
    return moves(base_signals(spark, d)).groupBy(F.col("signal_date").alias("day")).agg(
        F.count("*").alias("n"), F.countDistinct("instrument").alias("instruments"), F.count_if(F.col("rating") > F.col("prev_rating")).alias("upgrades"),
        F.count_if(F.col("rating") < F.col("prev_rating")).alias("downgrades"), F.array_sort(F.collect_set("currency")).alias("currencies"),
    )


@query(CHANGES + """
SELECT instrument, round(quantile_cont(CASE WHEN prev_target <> 0 AND prev_currency = currency THEN (target - prev_target) / abs(prev_target) * 100 END, 0.5), 6) AS median_pct, count(prev_target) AS n FROM moved GROUP BY instrument
""")
def median_pct_revision(spark: SparkSession, d: str) -> DataFrame:
    pct = F.when(F.col("prev_currency") == F.col("currency"), pct_change(F.col("target"), F.col("prev_target")))
    moved = checkpointed(moves(base_signals(spark, d)).select("instrument", pct.alias("pct"), "prev_target"))
    counts = moved.groupBy("instrument").agg(F.count("prev_target").alias("n"))
    return counts.join(interpolated(moved, ["instrument"], "pct", {"m": 0.5}), "instrument", "left").select("instrument", F.round("m", 6).alias("median_pct"), "n")


@query(SIGNALS + """, bounds AS (SELECT max(signal_date) - 365 AS since FROM signals),
ranked AS (SELECT instrument, broker, rating, signal_date, signal_date >= since AS inside FROM signals, bounds)
SELECT instrument, CAST(sum(CASE WHEN newest > base THEN 1 ELSE 0 END) AS BIGINT) AS up, CAST(sum(CASE WHEN newest < base THEN 1 ELSE 0 END) AS BIGINT) AS down, count(*) AS n FROM (
  SELECT instrument, broker, arg_max(rating, signal_date) FILTER (inside) AS newest, coalesce(arg_max(rating, signal_date) FILTER (NOT inside), arg_min(rating, signal_date) FILTER (inside)) AS base
  FROM ranked GROUP BY 1, 2 HAVING count(*) FILTER (inside) > 0) GROUP BY instrument
""")
def rating_movement(spark: SparkSession, d: str) -> DataFrame:
    """Newest rating in the last year against the last before it, else the oldest within it."""
    rows = base_signals(spark, d)
    since = rows.agg((F.max("signal_date") - F.expr("interval 365 days")).cast("date").alias("since"))
    inside = F.col("signal_date") >= F.col("since")
    when = lambda c: F.when(c, F.col("signal_date"))  # noqa: E731  max_by skips rows whose order is null
    ends = rows.crossJoin(F.broadcast(since)).groupBy("instrument", "broker").agg(
        F.count_if(inside).alias("k"), F.max_by("rating", when(inside)).alias("newest"), F.coalesce(F.max_by("rating", when(~inside)), F.min_by("rating", when(inside))).alias("base")
    )
    return ends.where("k > 0").groupBy("instrument").agg(F.count_if(F.col("newest") > F.col("base")).alias("up"), F.count_if(F.col("newest") < F.col("base")).alias("down"), F.count("*").alias("n"))


@query(LATEST + """
SELECT instrument, CAST(floor(quantile_cont(rating, 0.5) + 0.5) AS INTEGER) AS median_rating, CAST(sum(sign(rating)) AS BIGINT) AS net_rating, count(*) AS brokers FROM latest GROUP BY instrument HAVING count(rating) > 0
""")
def consensus_card(spark: SparkSession, d: str) -> DataFrame:
    rows = latest_per_broker(base_signals(spark, d)).groupBy("instrument")
    return rows.agg(median_rating(F.col("rating")).alias("median_rating"), F.sum(F.signum("rating")).cast("long").alias("net_rating"), F.count("*").alias("brokers"))


NEIGHBOURS = SIGNALS + """, near AS (
  SELECT a.instrument, a.broker, a.signal_date, a.currency, a.target, quantile_cont(b.target, 0.5) AS others, count(*) AS n FROM signals a
  JOIN signals b ON a.instrument = b.instrument AND a.broker = b.broker AND a.currency = b.currency AND a.signal_date <> b.signal_date AND abs(date_diff('day', a.signal_date, b.signal_date)) <= 45
  GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 2)
"""


def beside_neighbours(signals: DataFrame) -> DataFrame:
    """The signals with at least two neighbours, of one broker and currency within 45 days, and their median as others."""
    of = Window.partitionBy("instrument", "broker", "currency").orderBy("day")
    rows = signals.withColumn("day", F.datediff("signal_date", F.lit("1970-01-01").cast("date")))
    near = F.concat(F.collect_list("target").over(of.rangeBetween(-45, -1)), F.collect_list("target").over(of.rangeBetween(1, 45)))
    s, n = F.array_sort("near"), F.size("near")
    at = lambda k: F.get(s, F.floor(k).cast("int"))
    low, high = at((n - 1) / 2), at(n / 2)
    return rows.withColumn("near", near).where(F.size("near") >= 2).withColumn("others", low + (high - low) * 0.5)


@query(NEIGHBOURS + "SELECT instrument, broker, signal_date, target, target / others >= 3 OR target / others <= 1.0 / 3 AS implausible FROM near")
def implausible_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets beyond three times the median of at least two neighbours within 45 days, in one currency."""
    ratio = F.col("target") / F.col("others")
    return beside_neighbours(base_signals(spark, d)).select("instrument", "broker", "signal_date", "target", ((ratio >= 3) | (ratio <= 1.0 / 3)).alias("implausible"))


@query(NEIGHBOURS + """
SELECT instrument, broker, signal_date, currency, target AS old_target, CAST(NULL AS DOUBLE) AS new_target, CASE WHEN rating = 0 THEN 'valid' ELSE 'rated' END AS old_status, 'partial' AS new_status,
  'target ' || CASE WHEN target > others THEN 'above' ELSE 'below' END || ' three times the median of ' || n || ' neighbours' AS note
FROM near JOIN signals USING (instrument, broker, signal_date, currency, target) WHERE target / others >= 3 OR target / others <= 1.0 / 3
""")
def repair_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a repair of stored signals would change, and nothing else: targets that their neighbours belie are cleared, the
    row is partial from then on, and a note says why. The old values stand beside the new ones, so that the update can ask
    for them and pass over rows that have changed meanwhile."""
    rows = beside_neighbours(base_signals(spark, d))
    ratio = F.col("target") / F.col("others")
    side = F.when(F.col("target") > F.col("others"), "above").otherwise("below")
    note = F.concat(F.lit("target "), side, F.lit(" three times the median of "), F.size("near").cast("string"), F.lit(" neighbours"))
    return rows.where((ratio >= 3) | (ratio <= 1.0 / 3)).select(
        "instrument", "broker", "signal_date", "currency", F.col("target").alias("old_target"), F.lit(None).cast("double").alias("new_target"),
        F.when(F.col("rating") == 0, "valid").otherwise("rated").alias("old_status"), F.lit("partial").alias("new_status"), note.alias("note"),
    )
