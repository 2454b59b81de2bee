"""Instruments and their brokers: history, state of coverage, overview, names; and the building of signal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.frames import checkpointed
from corpusmill.plans.ranks import interpolated
from corpusmill.plans.registry import query
from corpusmill.sources.tables import load

from .signals import CHANGES, LATEST, SIGNALS, base_signals, latest_per_broker, median_rating, moves, within


@query(CHANGES + """, bounds AS (SELECT instrument, max(signal_date) AS as_of FROM signals GROUP BY instrument)
SELECT m.instrument, broker, count(*) AS reports, arg_max(rating, signal_date) AS latest_rating, max(signal_date) AS latest, arg_max(CASE WHEN rating <> prev_rating THEN 'rating' WHEN currency = prev_currency AND target <> prev_target THEN 'target' ELSE 'none' END, signal_date) AS changed,
  date_diff('day', max(signal_date), any_value(as_of)) > 180 AS stale FROM moved m JOIN bounds b USING (instrument) GROUP BY 1, 2
""")
def broker_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Each broker's newest signal of an instrument, what changed in it first, and whether it is out of the window."""
    rows = moves(base_signals(spark, d))
    changed = F.when(F.col("rating") != F.col("prev_rating"), "rating").when((F.col("currency") == F.col("prev_currency")) & (F.col("target") != F.col("prev_target")), "target").otherwise("none")
    by = rows.withColumn("changed", changed).groupBy("instrument", "broker").agg(
        F.count("*").alias("reports"), F.max_by("rating", "signal_date").alias("latest_rating"), F.max("signal_date").alias("latest"), F.max_by("changed", "signal_date").alias("changed")
    )
    as_of = by.groupBy("instrument").agg(F.max("latest").alias("as_of"))
    return by.join(as_of, "instrument").select("instrument", "broker", "reports", "latest_rating", "latest", "changed", (F.datediff("as_of", "latest") > 180).alias("stale"))


@query(SIGNALS + """, priced AS (SELECT *, lag(signal_date) OVER (PARTITION BY instrument, broker, currency ORDER BY signal_date) AS from_date, lag(target) OVER (PARTITION BY instrument, broker, currency ORDER BY signal_date) AS from_target,
  row_number() OVER (PARTITION BY instrument, broker ORDER BY signal_date) AS k FROM signals)
SELECT instrument, broker, signal_date, from_date, round(CASE WHEN from_target <> 0 THEN (target - from_target) / from_target * 100 END, 4) AS pct, CASE WHEN from_date IS NOT NULL THEN 'compared' WHEN k > 1 THEN 'nothing comparable' ELSE 'first' END AS note FROM priced
""")
def broker_history(spark: SparkSession, d: str) -> DataFrame:
    """Every signal against the broker's last one that can be compared with it (of the same currency)."""
    same = Window.partitionBy("instrument", "broker", "currency").orderBy("signal_date")
    k = F.row_number().over(Window.partitionBy("instrument", "broker").orderBy("signal_date"))
    rows = base_signals(spark, d).select("*", F.lag("signal_date").over(same).alias("from_date"), F.lag("target").over(same).alias("from_target"), k.alias("k"))
    pct = F.when(F.col("from_target") != 0, (F.col("target") - F.col("from_target")) / F.col("from_target") * 100)
    note = F.when(F.col("from_date").isNotNull(), "compared").when(F.col("k") > 1, "nothing comparable").otherwise("first")
    return rows.select("instrument", "broker", "signal_date", "from_date", F.round(pct, 4).alias("pct"), note.alias("note"))


def stance(rating: Column) -> Column:
    return F.when(rating > 0, "positive").when(rating < 0, "negative").otherwise("neutral")


@query(LATEST + """, cards AS (SELECT instrument, CAST(floor(quantile_cont(rating, 0.5) + 0.5) AS INTEGER) AS median_rating, count(*) AS brokers FROM latest GROUP BY instrument)
SELECT instrument, median_rating, brokers, (SELECT count(*) FROM cards WHERE median_rating = 0) AS total FROM cards WHERE median_rating = 0 ORDER BY brokers DESC, instrument LIMIT 10 OFFSET 2
""")
def stance_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the instruments of one stance; the stance is known only after aggregation, so the filter and the total come after it."""
    cards = latest_per_broker(base_signals(spark, d)).groupBy("instrument").agg(median_rating(F.col("rating")).alias("median_rating"), F.count("*").alias("brokers"))
    wanted = cards.where(stance(F.col("median_rating")) == "neutral")
    page = wanted.orderBy(F.desc("brokers"), "instrument").offset(2).limit(10)
    return page.crossJoin(wanted.agg(F.count("*").alias("total"))).select("instrument", "median_rating", "brokers", "total")


@query(LATEST + """, total AS (SELECT p_brand AS instrument, count(DISTINCT l_suppkey) AS brokers_total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
got AS (SELECT instrument, count(DISTINCT broker) AS brokers_extracted, bool_or(rating = -2) AS any_partial FROM signals WHERE broker % 10 <> 0 GROUP BY 1), used AS (SELECT instrument, count(*) AS brokers_in_consensus FROM latest WHERE broker % 10 <> 0 GROUP BY 1)
SELECT t.instrument, brokers_total, coalesce(brokers_extracted, 0) AS brokers_extracted, coalesce(brokers_in_consensus, 0) AS brokers_in_consensus,
  CASE WHEN brokers_extracted IS NULL THEN 'pending' WHEN any_partial AND brokers_extracted % 2 = 0 THEN 'partial' WHEN brokers_in_consensus IS NULL THEN 'window empty' WHEN brokers_extracted < brokers_total THEN 'partial' ELSE 'ok' END AS state
FROM total t LEFT JOIN got USING (instrument) LEFT JOIN used USING (instrument)
""")
def coverage_states(spark: SparkSession, d: str) -> DataFrame:
    """How far the brokers of an instrument are read: none yet, some only in part, none in the window, not all, all. Signals
    are read once: brokers are counted by instrument and newest date, and the window is a sum over these dates."""
    lines = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    total = lines.groupBy(F.col("p_brand").alias("instrument")).agg(F.countDistinct("l_suppkey").alias("brokers_total"))
    brokers = base_signals(spark, d).groupBy("instrument", "broker").agg(F.max("signal_date").alias("newest"), F.bool_or(F.col("rating") == -2).alias("partial"))
    read = F.col("broker") % 10 != 0
    days = brokers.groupBy("instrument", "newest").agg(F.count_if(read).alias("k"), F.bool_or(F.when(read, F.col("partial"))).alias("partial"))
    days = days.withColumn("last_date", F.max("newest").over(Window.partitionBy("instrument")))
    counted = lambda c: F.nullif(F.sum(c), F.lit(0))
    got = days.groupBy("instrument").agg(counted(F.col("k")).alias("e"), F.bool_or("partial").alias("partial"), counted(F.when(F.datediff("last_date", "newest") <= 180, F.col("k"))).alias("u"))
    rows = total.join(got, "instrument", "left")
    state = (
        F.when(F.col("e").isNull(), "pending").when(F.col("partial") & (F.col("e") % 2 == 0), "partial").when(F.col("u").isNull(), "window empty").when(F.col("e") < F.col("brokers_total"), "partial").otherwise("ok")
    )
    count = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return rows.select("instrument", "brokers_total", count(F.col("e"), "brokers_extracted"), count(F.col("u"), "brokers_in_consensus"), state.alias("state"))


@query(LATEST + """, rated AS (SELECT instrument, count(*) AS brokers, CAST(floor(quantile_cont(rating, 0.5) + 0.5) AS INTEGER) AS median_rating FROM latest GROUP BY 1),
money AS (SELECT instrument, currency, median FROM (SELECT instrument, currency, round(quantile_cont(target, 0.5), 6) AS median, row_number() OVER (PARTITION BY instrument ORDER BY count(*) DESC, currency) AS n FROM latest GROUP BY 1, 2) WHERE n = 1),
moved AS (SELECT *, lag(rating) OVER (PARTITION BY instrument, broker ORDER BY signal_date) AS prev_rating FROM signals), events AS (SELECT instrument, count(*) AS events FROM moved WHERE rating <> prev_rating GROUP BY 1),
names AS (SELECT p_brand AS instrument, min(p_name) AS name FROM part GROUP BY 1)
SELECT instrument, name, brokers, median_rating, currency, median AS median_target, coalesce(events, 0) AS events, least(5, coalesce(events, 0)) AS shown FROM rated JOIN money USING (instrument) JOIN names USING (instrument) LEFT JOIN events USING (instrument)
""")
def instrument_overview(spark: SparkSession, d: str) -> DataFrame:
    """All that an instrument's first page shows in one row."""
    newest = F.max_by(F.struct("signal_date", "rating", "target", "currency"), "signal_date")
    brokers = moves(base_signals(spark, d)).groupBy("instrument", "broker").agg(F.count_if(F.col("rating") != F.col("prev_rating")).alias("e"), newest.alias("s"))
    brokers = checkpointed(brokers.select("instrument", "broker", "e", "s.*"))
    latest = within(brokers)
    rated = latest.groupBy("instrument").agg(F.count("*").alias("brokers"), median_rating(F.col("rating")).alias("median_rating"))
    medians = interpolated(latest, ["instrument", "currency"], "target", {"m": 0.5}).select(F.col("instrument").alias("_of"), F.col("currency").alias("_in"), F.round("m", 6).alias("median_target"))
    same = F.col("instrument").eqNullSafe(F.col("_of")) & F.col("currency").eqNullSafe(F.col("_in"))
    money = latest.groupBy("instrument", "currency").agg(F.count("*").alias("k")).join(medians, same, "left")
    primary = money.groupBy("instrument").agg(F.max_by(F.struct("currency", "median_target"), F.struct("k", -F.col("currency"))).alias("x")).select("instrument", "x.*")
    events = brokers.groupBy("instrument").agg(F.sum("e").alias("e"))
    names = load(spark, d, "part").groupBy(F.col("p_brand").alias("instrument")).agg(F.min("p_name").alias("name"))
    rows = rated.join(primary, "instrument").join(names, "instrument").join(events, "instrument", "left")
    n = F.coalesce("e", F.lit(0))
    return rows.select("instrument", "name", "brokers", "median_rating", "currency", "median_target", n.alias("events"), F.least(F.lit(5), n).alias("shown"))


@query(CHANGES + """
SELECT m.instrument, coalesce(n.name, m.instrument) AS shown, broker, signal_date, rating - prev_rating AS step FROM moved m LEFT JOIN (SELECT p_brand, min(p_name) AS name FROM part WHERE p_size > 45 GROUP BY 1) n ON n.p_brand = m.instrument WHERE rating <> prev_rating
""")
def named_changes(spark: SparkSession, d: str) -> DataFrame:
    """Rating changes with the instrument's name, or its code where no name is known."""
    names = load(spark, d, "part").where("p_size > 45").groupBy(F.col("p_brand").alias("instrument")).agg(F.min("p_name").alias("name"))
    rows = moves(base_signals(spark, d)).where("rating <> prev_rating").join(names, "instrument", "left")
    return rows.select("instrument", F.coalesce("name", "instrument").alias("shown"), "broker", "signal_date", (F.col("rating") - F.col("prev_rating")).alias("step"))


@query(CHANGES + """
SELECT instrument, broker, signal_date, rating, prev_rating, CAST(row_number() OVER (PARTITION BY instrument ORDER BY signal_date DESC, broker) AS INTEGER) AS place FROM moved WHERE rating <> prev_rating
""")
def ordered_events(spark: SparkSession, d: str) -> DataFrame:
    """Changes of an instrument, newest first, brokers in order within a day."""
    place = F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("signal_date"), "broker"))
    return moves(base_signals(spark, d)).where("rating <> prev_rating").select("instrument", "broker", "signal_date", "rating", "prev_rating", place.alias("place"))


ANSWERS = r"""
WITH answers AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '```json' || chr(10) ELSE '' END || '{"signals": [{"instrument_code": "' || o_custkey || '", "rating": "' || CASE o_orderkey % 3 WHEN 0 THEN 'Buy' WHEN 1 THEN 'hold' ELSE 'n/a' END || '", "target_price": ' ||
  CASE o_orderkey % 5 WHEN 0 THEN '"NT$1,200"' WHEN 1 THEN 'null' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END || '}, 7, {"instrument_code": "0"}]' || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '}' END AS raw, CAST(o_custkey AS VARCHAR) AS wanted FROM orders)
"""


@query(ANSWERS + r"""
, read AS (SELECT o_orderkey, wanted, regexp_extract(raw, '(?s)(\{.*\})', 1) AS body FROM answers),
items AS (SELECT o_orderkey, wanted, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.signals[0].instrument_code') END AS code, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.signals[0].rating') END AS rating,
  CASE WHEN json_valid(body) THEN json_extract_string(body, '$.signals[0].target_price') END AS target FROM read),
done AS (SELECT *, CASE lower(rating) WHEN 'buy' THEN 'buy' WHEN 'hold' THEN 'neutral' ELSE 'unknown' END AS level, try_cast(replace(replace(target, ',', ''), 'NT$', '') AS DOUBLE) AS price FROM items)
SELECT o_orderkey, CASE WHEN NOT ok OR code IS DISTINCT FROM wanted THEN 'rejected' WHEN level = 'unknown' OR price IS NULL THEN 'partial' ELSE 'valid' END AS status, CASE WHEN ok AND code = wanted THEN level END AS rating, CASE WHEN ok AND code = wanted THEN price END AS target FROM done
""")
def signal_rows(spark: SparkSession, d: str) -> DataFrame:
    """Signal rows from a model's answers: the first item of the wanted code, bad items passed over; valid, partial if the
    rating or the target is missing, rejected if there is no such item or no JSON."""
    key, text = F.col("o_orderkey"), lambda x: F.lit(x)
    fence = F.when(key % 4 == 0, "```json\n").otherwise("")
    level = F.when(key % 3 == 0, "Buy").when(key % 3 == 1, "hold").otherwise("n/a")
    price = F.when(key % 5 == 0, '"NT$1,200"').when(key % 5 == 1, "null").otherwise(F.floor("o_totalprice").cast("string"))
    raw = F.concat(fence, text('{"signals": [{"instrument_code": "'), F.col("o_custkey").cast("string"), text('", "rating": "'), level, text('", "target_price": '), price, text('}, 7, {"instrument_code": "0"}]'), F.when(key % 7 == 0, "").otherwise("}"))
    rows = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("wanted"), F.regexp_extract(raw, r"(?s)(\{.*\})", 1).alias("body"))
    whole = F.when(F.try_parse_json("body").isNotNull(), F.get_json_object("body", "$.signals"))
    items = F.transform(F.from_json(whole, "array<string>"), lambda x: F.from_json(x, "instrument_code string, rating string, target_price string"))
    item = F.get(F.filter(items, lambda x: x["instrument_code"] == F.col("wanted")), F.lit(0))
    told = rows.withColumn("item", item)
    known = F.create_map(*[F.lit(x) for x in ("buy", "buy", "hold", "neutral")])
    level = F.coalesce(F.try_element_at(known, F.lower("item.rating")), F.lit("unknown"))
    target = F.regexp_replace(F.regexp_replace("item.target_price", ",", ""), r"NT\$", "").try_cast("double")
    there = F.col("item").isNotNull()
    told = told.select("o_orderkey", there.alias("there"), level.alias("level"), target.alias("price"))
    status = F.when(~F.col("there"), "rejected").when((F.col("level") == "unknown") | F.col("price").isNull(), "partial").otherwise("valid")
    return told.select("o_orderkey", status.alias("status"), F.when(F.col("there"), F.col("level")).alias("rating"), F.when(F.col("there"), F.col("price")).alias("target"))


@query("""
WITH cells AS (SELECT p_brand AS instrument, l_suppkey AS broker, o_orderdate::DATE AS day, l_returnflag AS dimension, CAST(sign(round(sum(l_discount - 0.05), 6)) AS INTEGER) AS stance FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3, 4),
moved AS (SELECT *, lag(stance) OVER (PARTITION BY instrument, broker, dimension ORDER BY day) AS prev FROM cells),
net AS (SELECT instrument, dimension, count(*) AS cells, count(*) FILTER (stance > prev) AS up, count(*) FILTER (stance < prev) AS down, count(prev) AS n FROM moved GROUP BY 1, 2)
SELECT instrument, dimension, cells, up, down, CASE WHEN n < 2 THEN 'insufficient' WHEN up + down = 0 THEN 'stable' WHEN least(up, down) >= 0.4 * (up + down) THEN 'diverging' WHEN up > down THEN 'strengthening' ELSE 'weakening' END AS label FROM net
""")
def thesis_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """A signal's theses, a map of stances by dimension: each dimension's stance against the broker's last one on it, and what
    the brokers' moves add up to."""
    lines = load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    keys = [F.col("p_brand").alias("instrument"), F.col("l_suppkey").alias("broker"), F.to_date("o_orderdate").alias("day")]
    stance = F.signum(F.round(F.sum(F.col("l_discount") - 0.05), 6)).cast("int")
    cells = lines.groupBy(*keys, "l_returnflag").agg(stance.alias("stance"))
    signals = cells.groupBy("instrument", "broker", "day").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "stance"))).alias("thesis"))
    told = signals.select("instrument", "broker", "day", F.explode("thesis").alias("dimension", "stance"))
    before = F.lag("stance").over(Window.partitionBy("instrument", "broker", "dimension").orderBy("day"))
    moved = told.withColumn("prev", before)
    net = moved.groupBy("instrument", "dimension").agg(
        F.count("*").alias("cells"), F.count_if(F.col("stance") > F.col("prev")).alias("up"), F.count_if(F.col("stance") < F.col("prev")).alias("down"), F.count("prev").alias("n")
    )
    total = F.col("up") + F.col("down")
    label = F.when(F.col("n") < 2, "insufficient").when(total == 0, "stable").when(F.least("up", "down") >= 0.4 * total, "diverging").when(F.col("up") > F.col("down"), "strengthening")
    return net.select("instrument", "dimension", "cells", "up", "down", label.otherwise("weakening").alias("label"))
