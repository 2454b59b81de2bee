"""Scans, filters, sorts, paging and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.registry import query
from corpusmill.sources.tables import load


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_brand = 'Brand#13' AND p_size BETWEEN 5 AND 30")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "part").where((F.col("p_brand") == "Brand#13") & F.col("p_size").between(5, 30))
    return rows.select("p_partkey", "p_name", "p_retailprice")


@query("SELECT c_custkey, c_mktsegment IS DISTINCT FROM 'BUILDING' AS other_segment FROM customer WHERE c_nationkey IS NOT DISTINCT FROM 7 OR c_acctbal < 0")
def null_safe_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer").where(F.col("c_nationkey").eqNullSafe(7) | (F.col("c_acctbal") < 0))
    return rows.select("c_custkey", (~F.col("c_mktsegment").eqNullSafe("BUILDING")).alias("other_segment"))


@query("""
SELECT p_partkey, list_contains(w, 'STANDARD') AS is_standard, list_has_any(w, ['BRUSHED', 'PLATED']) AS coated,
  len(list_filter(w, lambda x: NOT list_contains(['ECONOMY', 'BRASS', 'TIN', 'STEEL', 'NICKEL', 'COPPER'], x))) = 0 AS subset
FROM (SELECT p_partkey, string_split(upper(p_type), ' ') AS w FROM part)
""")
def array_predicates(spark: SparkSession, d: str) -> DataFrame:
    w = F.split(F.upper("p_type"), " ")
    plain = F.array(*[F.lit(x) for x in ("ECONOMY", "BRASS", "TIN", "STEEL", "NICKEL", "COPPER")])
    return load(spark, d, "part").select(
        "p_partkey", F.array_contains(w, "STANDARD").alias("is_standard"), F.arrays_overlap(w, F.array(F.lit("BRUSHED"), F.lit("PLATED"))).alias("coated"),
        (F.size(F.array_except(w, plain)) == 0).alias("subset"),
    )


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS opened, CAST(closed AS DATE) AS closed
FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS closed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
WHERE o_orderdate <= TIMESTAMP '1998-03-31' AND closed >= TIMESTAMP '1998-03-01'
""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    closed = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    rows = load(spark, d, "orders").join(closed, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.where("o_orderdate <= timestamp_ntz '1998-03-31 00:00:00' and closed >= timestamp_ntz '1998-03-01 00:00:00'").select(
        "o_orderkey", F.to_date("o_orderdate").alias("opened"), F.to_date("closed").alias("closed")
    )


@query(r"""
SELECT doc_id, contains(t, 'license') AS has_license, t LIKE 'the%' AS starts_the, contains(t, 'the') AND contains(t, 'and') AS all_terms,
  regexp_matches(t, '^(la|le|der|die) ') AS foreign_start
FROM (SELECT doc_id, lower(text) AS t FROM documents)
""")
def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower("text")
    return load(spark, d, "documents").select(
        "doc_id", t.contains("license").alias("has_license"), t.startswith("the").alias("starts_the"), (t.contains("the") & t.contains("and")).alias("all_terms"),
        t.rlike("^(la|le|der|die) ").alias("foreign_start"),
    )


@query("SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def visibility_anti(spark: SparkSession, d: str) -> DataFrame:
    hidden = load(spark, d, "labels").where("toxic = 1")
    return load(spark, d, "documents").join(hidden, "doc_id", "left_anti").select("doc_id", "lang", "source")


@query("""
SELECT c_custkey, c_nationkey FROM customer
WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))
""")
def entitlement_semi(spark: SparkSession, d: str) -> DataFrame:
    regions = load(spark, d, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    nations = load(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = load(spark, d, "customer")
    return customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"], "left_semi").select("c_custkey", "c_nationkey")


@query("""
SELECT d.doc_id, CASE WHEN n_chars < 200 THEN 'short' WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'done' END AS state,
  list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN l.quality = 0 THEN 'poor' END], lambda x: x IS NOT NULL) AS reasons
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def pending_work(spark: SparkSession, d: str) -> DataFrame:
    labels = load(spark, d, "labels").withColumn("labelled", F.lit(True))
    rows = load(spark, d, "documents").join(labels, "doc_id", "left")
    state = F.when(F.col("n_chars") < 200, "short").when(F.col("labelled").isNull(), "unlabelled").otherwise("done")
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("lang") != "en", "foreign"), F.when(F.col("quality") == 0, "poor")))
    return rows.select("doc_id", state.alias("state"), reasons.alias("reasons"))


@query("SELECT c_custkey, coalesce(nullif(trim(c_mktsegment), ''), nullif(trim(c_name), '')) AS canonical, CASE WHEN c_acctbal >= 5000 THEN 'hot' WHEN c_acctbal >= 0 THEN 'warm' ELSE 'cold' END AS tier FROM customer")
def canonical_name(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    tier = F.when(F.col("c_acctbal") >= 5000, "hot").when(F.col("c_acctbal") >= 0, "warm").otherwise("cold")
    return load(spark, d, "customer").select("c_custkey", F.coalesce(blank("c_mktsegment"), blank("c_name")).alias("canonical"), tier.alias("tier"))


@query("""
SELECT doc_id, source, n_chars, CAST(count(*) OVER () AS BIGINT) AS total FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25
""")
def total_before_limit(spark: SparkSession, d: str) -> DataFrame:
    """A page and the number of all rows, which is aggregated apart instead of by a window over one partition."""
    docs = load(spark, d, "documents").select("doc_id", "source", "n_chars")
    return docs.orderBy(F.desc("n_chars"), "doc_id").limit(25).crossJoin(docs.agg(F.count("*").alias("total")))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id < 5000 ORDER BY event_id DESC LIMIT 50")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").where("event_id < 5000").orderBy(F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


@query("""
SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 200) ORDER BY abs(n_chars - 2000), doc_id LIMIT 20
""")
def capped_then_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The reproducible cap: least ids that pass the filter, then exact distance."""
    capped = load(spark, d, "documents").where("lang = 'en'").orderBy("doc_id").limit(200)
    return capped.orderBy(F.abs(F.col("n_chars") - 2000), "doc_id").limit(20).select("doc_id", "n_chars")


@query("""
SELECT doc_id, lang, source, CAST(rn AS INTEGER) AS rn FROM (
  SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents)
WHERE rn % 5 = 1 AND rn <= 40
""")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth row of each stratum in digest order, up to a quota."""
    order = Window.partitionBy("lang", "source").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    rows = load(spark, d, "documents").select("doc_id", "lang", "source", F.row_number().over(order).alias("rn"))
    return rows.where("rn % 5 = 1 and rn <= 40")


@query("""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents) ORDER BY rn, lang LIMIT 60
""")
def stratified_round_robin(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    rows = load(spark, d, "documents").select("doc_id", "lang", F.row_number().over(order).alias("rn")).where("rn <= 60")
    return rows.orderBy("rn", "lang").limit(60).select("doc_id", "lang")


@query("""
SELECT 'quality' AS kind, CAST(quality AS VARCHAR) AS value, count(*) AS n FROM labels GROUP BY 2
UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM labels GROUP BY 2
UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2
""")
def union_tagged(spark: SparkSession, d: str) -> DataFrame:
    labels, docs = load(spark, d, "labels"), load(spark, d, "documents")
    counts = lambda df, c: df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("kind"), "value", "n")
    return counts(labels, "quality").unionByName(counts(labels, "toxic")).unionByName(counts(docs, "lang"))


@query("""
SELECT day, count(DISTINCT u) AS active FROM (
  SELECT CAST(ts AS DATE) AS day, user_id AS u FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT CAST(ts AS DATE), user_id FROM events WHERE event_type = 'signup') GROUP BY day
""")
def active_union(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    part = lambda kind: events.where(F.col("event_type") == kind).select(F.to_date("ts").alias("day"), "user_id")
    return part("purchase").unionByName(part("signup")).groupBy("day").agg(F.countDistinct("user_id").alias("active"))


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def intersect_keys(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    return events.where("event_type = 'purchase'").select("user_id").intersect(events.where("event_type = 'error'").select("user_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_orphans(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id").exceptAll(load(spark, d, "labels").select("doc_id")).distinct()


@query("""
WITH ranked AS (
  SELECT c_custkey AS id, 0 AS list_no, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer WHERE c_acctbal > 9000
  UNION ALL SELECT c_custkey, 1, row_number() OVER (ORDER BY c_acctbal, c_custkey) FROM customer WHERE c_acctbal < -900
  UNION ALL SELECT c_custkey, 2, row_number() OVER (ORDER BY c_custkey) FROM customer WHERE c_acctbal > 9500)
SELECT id, CAST(row_number() OVER (ORDER BY pos, list_no, id) AS INTEGER) AS place FROM (
  SELECT id, pos, list_no, row_number() OVER (PARTITION BY id ORDER BY pos, list_no) AS n FROM ranked) WHERE n = 1
ORDER BY place LIMIT 30
""")
def interleave_lists(spark: SparkSession, d: str) -> DataFrame:
    """Round-robin merge of three ranked lists, each id at its first place. Only the first 30 of a list can matter."""
    rows = load(spark, d, "customer")

    def part(condition: str, order: list, no: int) -> DataFrame:
        top = rows.where(condition).orderBy(*order).limit(30)
        return top.select(F.col("c_custkey").alias("id"), F.lit(no).alias("list_no"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("pos"))

    lists = part("c_acctbal > 9000", [F.desc("c_acctbal"), F.col("c_custkey")], 0).unionByName(part("c_acctbal < -900", [F.col("c_acctbal"), F.col("c_custkey")], 1))
    lists = lists.unionByName(part("c_acctbal > 9500", [F.col("c_custkey")], 2))
    first = lists.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("pos", "list_no"))).where("n = 1")
    return first.select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pos", "list_no", "id")).alias("place")).where("place <= 30")
