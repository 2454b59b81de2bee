"""Joins: equi, outer, lateral, band, as-of, reachability, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.frames import checkpointed
from corpusmill.plans.graphs import layers
from corpusmill.plans.registry import query
from corpusmill.sources import sinks
from corpusmill.sources.tables import load

from .signals import SIGNALS, base_signals


@query("""
SELECT n_name, p_brand, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY n_name, p_brand
""")
def join_inner_equi(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").join(load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name", "p_brand").agg(F.sum("l_quantity").cast("long").alias("quantity"))


@query("""
SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_urgent, coalesce(max(o_totalprice), 0) AS most
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey
""")
def join_left_cond(spark: SparkSession, d: str) -> DataFrame:
    urgent = load(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("m"))
    rows = load(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_urgent"), F.coalesce("m", F.lit(0.0)).alias("most"))


@query("""
SELECT c_custkey, (SELECT o_orderpriority FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest FROM customer
""")
def scalar_latest_name(spark: SparkSession, d: str) -> DataFrame:
    """The correlated look-up of the latest value as one grouped pass."""
    latest = load(spark, d, "orders").where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return load(spark, d, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "latest")


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey AND p_size = 1 AND l_quantity > 45)")
def exists_semi(spark: SparkSession, d: str) -> DataFrame:
    small = load(spark, d, "part").where("p_size = 1")
    lines = load(spark, d, "lineitem").where("l_quantity > 45").join(small, F.col("l_partkey") == F.col("p_partkey"))
    suppliers = load(spark, d, "supplier")
    return suppliers.join(lines, suppliers["s_suppkey"] == lines["l_suppkey"], "left_semi").select("s_suppkey", "s_name")


EDGES = """
WITH RECURSIVE edges AS (SELECT o_orderkey AS child, parent FROM (SELECT o_orderkey, o_orderkey % 4 AS kind, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders) WHERE parent IS NOT NULL AND kind <> 0),
reach AS (SELECT child AS node, parent AS ancestor FROM edges UNION SELECT r.node, e.parent FROM reach r JOIN edges e ON e.child = r.ancestor)
"""


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    """node, ancestor: orders that depend on the customer's order before."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("node"), before.alias("ancestor")).where("ancestor is not null and node % 4 <> 0")


def closure(edges: DataFrame) -> DataFrame:
    """All (node, ancestor) pairs of a graph's edges. Paths of at most 2^k steps meet those of just 2^k, so that the number
    of rounds is the logarithm of the longest path; each round is checkpointed and counted, and joins nothing twice."""
    reach = step = checkpointed(edges.select("node", "ancestor").distinct())
    size = -1
    while (now := reach.count()) != size:
        size = now
        on = lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.ancestor") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"))
        longer = on(reach, step)
        step = checkpointed(on(step, step).distinct())
        reach = checkpointed(reach.union(longer).distinct())
    return reach


@query(EDGES + "SELECT node, ancestor FROM reach")
def recursive_closure(spark: SparkSession, d: str) -> DataFrame:
    """All orders that an order depends on."""
    return closure(dependencies(spark, d))


#: A graph with several parents and cycles: an order needs the customer's order before (as above), each third one also the
#: one before that; where a key is divisible by 41, the order before needs it in turn.
GRAPH = """
WITH RECURSIVE placed AS (SELECT o_orderkey AS node, o_orderstatus, lag(o_orderkey) OVER w AS one, lag(o_orderkey, 2) OVER w AS two FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
edges AS (SELECT node, one AS ancestor FROM placed WHERE one IS NOT NULL AND node % 4 <> 0 UNION SELECT node, two FROM placed WHERE two IS NOT NULL AND node % 3 = 0 UNION SELECT one, node FROM placed WHERE one IS NOT NULL AND node % 41 = 0),
reach AS (SELECT node, ancestor FROM edges UNION SELECT r.node, e.ancestor FROM reach r JOIN edges e ON e.node = r.ancestor),
cyclic AS (SELECT DISTINCT node FROM reach WHERE ancestor IN (SELECT node FROM reach WHERE node = ancestor))
"""


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The nodes (node, status) and the edges (node, ancestor) of GRAPH."""
    of = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    lag = lambda k: F.lag("o_orderkey", k).over(of)
    placed = load(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderstatus").alias("status"), lag(1).alias("one"), lag(2).alias("two"))
    edge = lambda node, ancestor: F.struct(node.alias("node"), ancestor.alias("ancestor"))
    node, one, two = F.col("node"), F.col("one"), F.col("two")
    some = F.array(F.when(node % 4 != 0, edge(node, one)), F.when(node % 3 == 0, edge(node, two)), F.when(node % 41 == 0, edge(one, node)))
    return placed.select("node", "status"), placed.select(F.inline(F.array_compact(some))).where("node is not null and ancestor is not null")


@query(GRAPH + """, steps AS (SELECT node, 0 AS n FROM placed WHERE node NOT IN (SELECT node FROM edges) UNION SELECT e.node, s.n + 1 FROM steps s JOIN edges e ON e.ancestor = s.node WHERE e.node NOT IN (SELECT node FROM cyclic)),
deep AS (SELECT node, max(n) AS layer FROM steps GROUP BY 1),
behind AS (SELECT e.node, max(d.layer) + 1 AS layer FROM edges e JOIN deep d ON d.node = e.ancestor GROUP BY 1)
SELECT p.node, coalesce(d.layer, b.layer, 0) AS layer, d.node IS NULL AS cyclic FROM placed p LEFT JOIN deep d USING (node) LEFT JOIN behind b USING (node)
""")
def dependency_layers(spark: SparkSession, d: str) -> DataFrame:
    """The layer of each order: those that depend on nothing are 0, others one above the deepest that they depend on; those
    on a cycle or behind one are told apart."""
    nodes, edges = graph(spark, d)
    return layers(nodes, edges)


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id AS probe, v AS pv FROM e WHERE vec_id % 20 = 0)
SELECT probe, vec_id, CAST(rn AS INTEGER) AS rn FROM (
  SELECT probe, vec_id, row_number() OVER (PARTITION BY probe ORDER BY round(1 - list_cosine_similarity(pv, v), 9), vec_id) AS rn FROM p, e WHERE vec_id <> probe) WHERE rn <= 5
""")
def lateral_topk_probe(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest neighbours of every twentieth vector among all."""
    from .retrieval import nearest

    vectors = load(spark, d, "embeddings")
    return nearest(vectors.where("vec_id % 20 = 0"), vectors, 5).select("probe", "vec_id", "rn")


@query(SIGNALS + """
SELECT a.instrument, a.broker, a.signal_date, CAST(count(*) AS BIGINT) AS neighbours, max(b.target) AS highest
FROM signals a JOIN signals b ON a.instrument = b.instrument AND a.broker = b.broker AND a.signal_date <> b.signal_date
  AND abs(date_diff('day', a.signal_date, b.signal_date)) <= 45
GROUP BY ALL
""")
def band_neighbors_45d(spark: SparkSession, d: str) -> DataFrame:
    """Other signals of the same instrument and broker within 45 days: a range frame on the day number, less the row
    itself, instead of a self-join over all pairs of a group."""
    day = F.datediff(F.col("signal_date"), F.lit("1970-01-01").cast("date"))
    of = Window.partitionBy("instrument", "broker").orderBy("day")
    before, after = of.rangeBetween(-45, -1), of.rangeBetween(1, 45)
    rows = base_signals(spark, d).withColumn("day", day)
    n = F.count("*").over(before) + F.count("*").over(after)
    return rows.select("instrument", "broker", "signal_date", n.alias("neighbours"), F.greatest(F.max("target").over(before), F.max("target").over(after)).alias("highest")).where("neighbours > 0")


@query(SIGNALS + """
SELECT instrument, broker, signal_date, target, last_value(CASE WHEN rating >= 0 THEN target END IGNORE NULLS) OVER (
  PARTITION BY instrument, broker, currency ORDER BY signal_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_target FROM signals
""")
def asof_same_currency(spark: SparkSession, d: str) -> DataFrame:
    """The latest earlier target of the same currency from a rated row: a conditional as-of join as one window."""
    before = Window.partitionBy("instrument", "broker", "currency").orderBy("signal_date").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last(F.when(F.col("rating") >= 0, F.col("target")), ignorenulls=True).over(before)
    return base_signals(spark, d).select("instrument", "broker", "signal_date", "target", prior.alias("prior_target"))


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'orphan' WHEN (n_chars < 100) <> (quality = 0) THEN 'mismatch' ELSE 'ok' END AS state
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id
""")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Two inventories compared by key."""
    docs = load(spark, d, "documents").select("doc_id", "n_chars", F.lit(True).alias("here"))
    labels = load(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "orphan").when((F.col("n_chars") < 100) != (F.col("quality") == 0), "mismatch").otherwise("ok")
    return docs.join(labels, "doc_id", "full_outer").select("doc_id", state.alias("state"))


@query("""
SELECT event_id, user_id, EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'signup' AND (b.ts, b.event_id) > (a.ts, a.event_id)) AS lost
FROM events a WHERE event_type = 'signup'
""")
def superseded_starts(spark: SparkSession, d: str) -> DataFrame:
    """Starts that a later start of the same key has made obsolete: lead() in place of an inequality join."""
    starts = load(spark, d, "events").where("event_type = 'signup'")
    later = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return starts.select("event_id", "user_id", later.isNotNull().alias("lost"))


@query("""
SELECT user_id, CAST(sum(n) AS BIGINT) AS hits, max(n) AS users FROM (
  SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1 UNION ALL SELECT user_id, count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1) GROUP BY user_id
""")
def merge_counters(spark: SparkSession, d: str) -> DataFrame:
    """Additive upsert: hits add up, users take the greater."""
    events = load(spark, d, "events")
    part = lambda when: events.where(when).groupBy("user_id").agg(F.count("*").alias("hits")).withColumn("users", F.col("hits"))
    return sinks.merge_counts(part("ts < timestamp_ntz '2024-01-15 00:00:00'"), part("ts >= timestamp_ntz '2024-01-15 00:00:00'"), ["user_id"], ["hits"], ["users"])


@query("""
SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1
""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Last writer wins by natural key."""
    latest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return load(spark, d, "orders").withColumn("n", F.row_number().over(latest)).where("n = 1").select("o_custkey", "o_orderkey", "o_orderdate")


@query("""
SELECT source, list_sort(list_distinct(flatten(list(langs)))) AS langs FROM (
  SELECT source, list(DISTINCT lang) AS langs FROM documents WHERE doc_id % 2 = 0 GROUP BY 1 UNION ALL SELECT source, list(DISTINCT lang) FROM documents WHERE doc_id % 2 = 1 GROUP BY 1) GROUP BY source
""")
def merge_sets(spark: SparkSession, d: str) -> DataFrame:
    """Set-union upsert of an array column."""
    docs = load(spark, d, "documents")
    part = lambda odd: docs.where(F.col("doc_id") % 2 == odd).groupBy("source").agg(F.collect_set("lang").alias("langs"))
    return sinks.union_arrays(part(0), part(1), ["source"], "langs")


@query("""
SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) FILTER (n <= 3) AS BIGINT) AS counted, CAST(count(*) FILTER (n > 3) AS BIGINT) AS over
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click') GROUP BY 1, 2
""")
def quota_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts up to a daily limit, the rest apart: both follow from the daily number alone."""
    days = load(spark, d, "events").where("event_type = 'click'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.select("user_id", "day", F.least("n", F.lit(3)).alias("counted"), F.greatest(F.col("n") - 3, F.lit(0)).alias("over"))
