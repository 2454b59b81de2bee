"""Ledgers, tombstones, drift, queues, snapshots, grouped facts and field-level differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import textfns
from corpusmill.plans.frames import checkpointed
from corpusmill.plans.ranks import nearest_rank
from corpusmill.plans.registry import query
from corpusmill.plans.running import running
from corpusmill.sources import sinks
from corpusmill.sources.tables import load

from .signals import CHANGES, base_signals, moves


@query("SELECT s_suppkey, s_name, wanted.note FROM supplier JOIN (VALUES (3, 'a'), (7, 'b'), (11, 'c')) AS wanted(nation, note) ON s_nationkey = nation")
def inline_relation(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.sql("SELECT * FROM VALUES (3, 'a'), (7, 'b'), (11, 'c') AS wanted(nation, note)")
    return load(spark, d, "supplier").join(wanted, F.col("s_nationkey") == F.col("nation")).select("s_suppkey", "s_name", "note")


@query("SELECT (SELECT max(ts) FROM events) AS last_event, (SELECT count(*) FROM documents) AS documents, (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'O') AS last_open")
def scalar_subqueries(spark: SparkSession, d: str) -> DataFrame:
    one = load(spark, d, "events").agg(F.max("ts").alias("last_event"))
    return one.crossJoin(load(spark, d, "documents").agg(F.count("*").alias("documents"))).crossJoin(load(spark, d, "orders").where("o_orderstatus = 'O'").agg(F.max("o_orderdate").alias("last_open")))


@query("""
WITH ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY source) AS total FROM documents),
pick AS (SELECT source, i, CAST(floor(i * total / 5.0) AS BIGINT) AS rn FROM (SELECT DISTINCT source, total FROM ranked), generate_series(0, 4) AS g(i) WHERE i < total)
SELECT p.source, CAST(p.i AS INTEGER) AS i, r.doc_id FROM pick p JOIN ranked r ON r.source = p.source AND r.rn = p.rn
""")
def position_join(spark: SparkSession, d: str) -> DataFrame:
    """Five evenly spaced documents of each source, by their place in it: which picks a place is, if any, follows from it
    and the source's size. A source that holds most documents is numbered by ranges."""
    rows = load(spark, d, "documents").where("source is not null").select("doc_id", "source", F.lit(1).alias("one"))
    placed = running(rows, ["source"], ["doc_id"], {"place": "one"}).withColumnRenamed("_total_place", "total")
    at = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when((i < F.col("total")) & (F.floor(i * F.col("total") / 5.0) == F.col("place") - 1), i))
    return placed.select("source", F.explode(F.array_compact(at)).alias("i"), "doc_id")


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def month_groups(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
WITH fails AS (SELECT user_id, ts, event_id, event_id % 3 AS model FROM events WHERE event_type = 'error'),
marked AS (SELECT *, CASE WHEN model IS DISTINCT FROM lag(model) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS fresh FROM fails),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT user_id, model, fails FROM (SELECT user_id, run, any_value(model) AS model, count(*) AS fails, row_number() OVER (PARTITION BY user_id ORDER BY run DESC) AS n FROM runs GROUP BY user_id, run) WHERE n = 1
""")
def failure_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Failures in a row of the same model; another model starts anew."""
    of = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = load(spark, d, "events").where("event_type = 'error'").select("user_id", "ts", "event_id", (F.col("event_id") % 3).alias("model"))
    marked = rows.withColumn("fresh", (~F.col("model").eqNullSafe(F.lag("model").over(of))).cast("int")).withColumn("run", F.sum("fresh").over(of.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = marked.groupBy("user_id", "run", "model").agg(F.count("*").alias("fails"))
    return runs.groupBy("user_id").agg(F.max_by(F.struct("model", "fails"), "run").alias("x")).select("user_id", "x.model", "x.fails")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def tombstone_replay(spark: SparkSession, d: str) -> DataFrame:
    return sinks.without_tombstones(load(spark, d, "documents").select("doc_id", "lang"), load(spark, d, "labels").where("quality = 0"), ["doc_id"])


@query(r"SELECT count(*) AS n, count(*) FILTER (regexp_replace(lower(text), '\s+', '', 'g') <> regexp_replace(lower(trim(text)) || CASE WHEN doc_id % 50 = 0 THEN '.' ELSE '' END, '\s+', '', 'g')) AS drifted FROM documents")
def normalisation_drift(spark: SparkSession, d: str) -> DataFrame:
    """Stored against recomputed normal form; every fiftieth stored one is off."""
    stored = F.regexp_replace(F.concat(F.lower(F.trim("text")), F.when(F.col("doc_id") % 50 == 0, ".").otherwise("")), r"(?U)\s+", "")
    rows = load(spark, d, "documents").select(stored.alias("stored"), textfns.norm_for_match("text").alias("now"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("stored") != F.col("now")).alias("drifted"))


@query("""
SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'hidden' END, 'open') AS status, n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1 WHERE lang <> 'en' ORDER BY n_chars, d.doc_id LIMIT 40
""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    hidden = load(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("hidden").alias("s"))
    rows = load(spark, d, "documents").where("lang <> 'en'").join(hidden, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("s", F.lit("open")).alias("status"), "n_chars").orderBy("n_chars", "doc_id").limit(40)


@query("""
SELECT conv_id, round(count(*) FILTER (length(text) > 100) / count(*), 6) AS faithfulness, count(*) AS claims FROM conversations GROUP BY conv_id ORDER BY faithfulness, conv_id LIMIT 20
""")
def faithfulness_worst(spark: SparkSession, d: str) -> DataFrame:
    """Least supported answers first; a long turn stands for a supported claim."""
    rows = load(spark, d, "conversations").groupBy("conv_id").agg(F.round(F.count_if(F.length("text") > 100) / F.count("*"), 6).alias("faithfulness"), F.count("*").alias("claims"))
    return rows.orderBy("faithfulness", "conv_id").limit(20)


@query("""
SELECT 'documents' AS name, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS size FROM documents UNION ALL SELECT 'pages', count(*), CAST(sum(length(html)) AS BIGINT) FROM pages
UNION ALL SELECT 'conversations', count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations
""")
def stats_snapshot(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, c: load(spark, d, name).agg(F.count("*").alias("n"), F.sum(F.length(c)).alias("size")).select(F.lit(name).alias("name"), "n", "size")
    return part("documents", "text").unionByName(part("pages", "html")).unionByName(part("conversations", "text"))


@query("""
WITH facts AS (SELECT p_brand AS instrument, year(l_shipdate) AS fiscal_year, l_returnflag AS period, s_nationkey % 3 AS currency, l_linestatus AS unit, l_suppkey AS broker, max(l_extendedprice / l_quantity / 100) AS eps
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
groups AS (SELECT instrument, fiscal_year, period, currency, unit, count(*) AS brokers, quantile_disc(eps, 0.5) AS median, min(eps) AS low, max(eps) AS high FROM facts GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY brokers DESC, fiscal_year DESC, period, currency, unit) = 1 AS is_primary FROM groups
""")
def eps_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Estimates by instrument, year, period, currency and unit, one of each broker, for only such can be compared; the
    group of most brokers is the primary one."""
    keys = ["instrument", "fiscal_year", "period", "currency", "unit"]
    lines = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(load(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    named = lines.select(
        F.col("p_brand").alias("instrument"), F.year("l_shipdate").cast("long").alias("fiscal_year"), F.col("l_returnflag").alias("period"), (F.col("s_nationkey") % 3).alias("currency"),
        F.col("l_linestatus").alias("unit"), "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity") / 100).alias("eps"),
    )
    facts = checkpointed(named.groupBy(*keys, "l_suppkey").agg(F.max("eps").alias("eps")))
    groups = facts.groupBy(*keys).agg(F.count("*").alias("brokers"), F.min("eps").alias("low"), F.max("eps").alias("high"))
    groups = groups.join(nearest_rank(facts, keys, "eps", {"median": 0.5}), keys)
    first = F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("brokers"), F.desc("fiscal_year"), "period", "currency", "unit"))
    return groups.withColumn("is_primary", first == 1)


@query(CHANGES + """
SELECT instrument, broker, signal_date, list_filter([CASE WHEN rating <> prev_rating THEN 'rating' END, CASE WHEN target <> prev_target THEN 'target' END, CASE WHEN currency <> prev_currency THEN 'currency' END], lambda x: x IS NOT NULL) AS fields
FROM moved WHERE prev_rating IS NOT NULL
""")
def signal_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Which fields differ from the broker's signal before."""
    changed = F.array_compact(F.array(*[F.when(F.col(c) != F.col(f"prev_{c}"), c) for c in ("rating", "target", "currency")]))
    return moves(base_signals(spark, d)).where("prev_rating is not null").select("instrument", "broker", "signal_date", changed.alias("fields"))


@query(r"SELECT page_id FROM pages WHERE try_cast(regexp_extract(url, '/(\d+)', 1) AS BIGINT) NOT IN (SELECT doc_id FROM labels) AND regexp_matches(url, '/\d+')")
def orphan_attachments(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose number no label refers to."""
    number = F.regexp_extract("url", r"/(\d+)", 1).try_cast("long")
    pages = load(spark, d, "pages").where(F.col("url").rlike(r"/\d+")).select("page_id", number.alias("doc_id"))
    return pages.join(load(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("page_id")
