"""Files between jobs: caches, spools, indexes, exports. Each query writes files to the shared folder and reads them back."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.registry import query
from corpusmill.sources import sinks
from corpusmill.sources.tables import load
from corpusmill.sources.tail import SettledSource, SpoolSource
from corpusmill.streaming.streams import shared_folder

from .text import LINES, boilerplate

RECORD = "doc_id bigint, sha string, n_chars bigint, failed boolean"


@query("SELECT substr(md5(text), 1, 1) AS head, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(*) FILTER (n_chars < 100) AS failed FROM documents WHERE substr(md5(text), 1, 1) IN ('0', '7', 'c') GROUP BY 1")
def json_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache of JSON records by the digest of what they are about; a look-up reads only the folders of its digests."""
    path = f"{shared_folder(spark)}/cache"
    sha = F.md5(F.col("text").cast("binary"))
    records = load(spark, d, "documents").select("doc_id", sha.alias("sha"), "n_chars", (F.col("n_chars") < 100).alias("failed"))
    records.withColumn("head", F.substring("sha", 1, 1)).write.partitionBy("head").json(path)
    found = spark.read.schema(f"{RECORD}, head string").json(path).where(F.col("head").isin("0", "7", "c"))
    return found.groupBy("head").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.count_if("failed").alias("failed"))


def spooled(spark: SparkSession, d: str) -> DataFrame:
    """event_id, value: the events as lines of a spool, every fiftieth cut off in the middle."""
    rows = load(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", F.col("ts").cast("string").alias("ts"), "event_type", "value")).alias("line"))
    cut = F.substring(F.col("line"), F.lit(1), F.floor(F.length("line") / 2).cast("int"))
    return rows.select("event_id", F.when(F.col("event_id") % 50 == 0, cut).otherwise(F.col("line")).alias("value"))


EVENT = "event_id bigint, ts string, event_type string, value double"


@query("SELECT CASE WHEN event_id % 50 = 0 THEN '(rejected)' ELSE event_type END AS kind, count(*) AS n, count(*) FILTER (event_id % 2 = 1) AS second_part FROM events GROUP BY 1")
def stream_spool(spark: SparkSession, d: str) -> DataFrame:
    """A spool of JSON lines followed from byte to byte; it stops, more is spooled, and it goes on where its checkpoint
    says. Lines that are no record are told apart and not lost; a line that has no end yet waits for it."""
    root = shared_folder(spark)
    lines = spooled(spark, d)
    spark.dataSource.register(SpoolSource)
    for part in (0, 1):
        lines.where(F.col("event_id") % 2 == part).select(F.col("value")).write.mode("append").text(f"{root}/spool")
        stream = spark.readStream.format("spool").option("path", f"{root}/spool").option("maxBytes", str(64 << 20)).load()
        read = stream.select(F.from_json("value", EVENT).alias("e"), F.lit(part).alias("part"))
        rows = read.select(F.coalesce(F.when(F.col("e.event_type").isNotNull() & F.col("e.value").isNotNull(), F.col("e.event_type")), F.lit("(rejected)")).alias("kind"), "part")
        write = rows.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        while True:  # a run takes one budget
            run = write.trigger(availableNow=True).start()
            run.awaitTermination()
            if not any(p["numInputRows"] for p in run.recentProgress):
                break
    return spark.read.schema("kind string, part int").parquet(f"{root}/out").groupBy("kind").agg(F.count("*").alias("n"), F.sum("part").cast("long").alias("second_part"))


@query("SELECT source, count(*) AS n, 1 AS files FROM documents GROUP BY source")
def stream_settled_files(spark: SparkSession, d: str) -> DataFrame:
    """A folder with a file for each source, followed once it has come to rest; files of another kind are left alone. How many
    files of each source were found, however often the folder was looked at, beside the source's rows."""
    root = shared_folder(spark)
    docs = load(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source"))
    docs.withColumn("of", F.col("source")).repartition("of").write.partitionBy("of").json(f"{root}/in")
    docs.select("source").distinct().coalesce(1).write.text(f"{root}/in/notes")
    time.sleep(1)
    spark.dataSource.register(SettledSource)
    stream = spark.readStream.format("settled").option("path", f"{root}/in").option("suffixes", ".json").option("settleSeconds", "0.5").load()
    for _ in range(2):  # the second finds nothing new
        stream.writeStream.format("parquet").option("path", f"{root}/found").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("path string, modified timestamp, size bigint, fingerprint string").parquet(f"{root}/found")
    name = F.regexp_extract(F.col("path"), r"/of=([^/]*)/", 1)
    files = found.select(name.alias("of"), "fingerprint").distinct().groupBy("of").agg(F.count("*").cast("int").alias("files"))
    rows = spark.read.schema("doc_id bigint, source string, of string").json(f"{root}/in/of=*", recursiveFileLookup=True).groupBy("source").agg(F.count("*").alias("n"))
    back = F.when(F.col("source") != "(none)", F.col("source")).alias("source")
    return rows.join(files, rows["source"] == files["of"]).select(back, "n", "files")


@query("""
SELECT kind, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT CASE WHEN event_id % 20 = 0 THEN 'capacity' WHEN event_id % 97 = 0 THEN 'meta' ELSE 'sample' END AS kind, CASE WHEN event_id % 20 <> 0 AND event_id % 97 = 0 THEN NULL ELSE value END AS value FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 5 DAY) GROUP BY 1
""")
def sample_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Lines of several kinds in one file, the latest five days of them, taken apart by kind."""
    path = f"{shared_folder(spark)}/samples"
    i = F.col("event_id")
    kind = F.when(i % 20 == 0, "capacity").when(i % 97 == 0, "meta").otherwise("sample")
    value = F.when(kind != "meta", F.col("value"))
    load(spark, d, "events").select(kind.alias("kind"), F.col("ts").cast("string").alias("at"), value.alias("value")).write.json(path)
    rows = spark.read.schema("kind string, at string, value double").json(path).withColumn("at", F.col("at").cast("timestamp_ntz"))
    end = rows.agg((F.max("at") - F.expr("interval 5 days")).alias("since"))
    return rows.crossJoin(F.broadcast(end)).where("at > since").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("WITH" + LINES + "SELECT source, count(*) AS keys, CAST(sum(n_docs) AS BIGINT) AS n_docs FROM kept GROUP BY 1")
def index_files(spark: SparkSession, d: str) -> DataFrame:
    """The index of boilerplate written as one folder for each source, and read back."""
    path = f"{shared_folder(spark)}/index"
    boilerplate(load(spark, d, "documents")).write.partitionBy("source").json(path)
    rows = spark.read.schema("key string, n_docs bigint, source string").json(path)
    return rows.groupBy("source").agg(F.count("*").alias("keys"), F.sum("n_docs").alias("n_docs"))


@query("""
SELECT CASE WHEN regexp_matches(x, '^[=+@\t\r-]') THEN '''' || x ELSE x END AS cell, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN '=' || o_orderpriority WHEN 1 THEN '-' || o_orderstatus ELSE o_orderpriority END AS x FROM orders ORDER BY o_orderkey LIMIT 10000) GROUP BY 1
""")
def export_cells(spark: SparkSession, d: str) -> DataFrame:
    """An export of at most ten thousand rows, as it may have, with what would be a formula made text, and read back."""
    path = f"{shared_folder(spark)}/export"
    cell = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("="), "o_orderpriority")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("-"), "o_orderstatus")).otherwise(F.col("o_orderpriority"))
    sinks.export_csv(load(spark, d, "orders").select("o_orderkey", cell.alias("cell")), path, 10_000, [F.col("o_orderkey")])
    return spark.read.option("header", "true").schema("o_orderkey bigint, cell string").csv(path).groupBy("cell").agg(F.count("*").alias("n"))


@query("SELECT 'documents' AS name, count(*) AS n, max(doc_id) AS last FROM documents UNION ALL SELECT 'events', count(*), max(event_id) FROM events")
def result_file(spark: SparkSession, d: str) -> DataFrame:
    """A small result as one JSON file, which takes the old one's place only when it is whole."""
    path = f"{shared_folder(spark)}/result"
    one = lambda name, key: load(spark, d, name).agg(F.count("*").alias("n"), F.max(key).alias("last")).select(F.lit(name).alias("name"), "n", "last")
    for tables in ([("events", "event_id")], [("documents", "doc_id"), ("events", "event_id")]):  # the second replaces the first
        rows = [one(*t) for t in tables]
        sinks.write_result(rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1]), path)
    return spark.read.schema("name string, n bigint, last bigint").json(path)


@query(r"""
SELECT problems, count(*) AS n, min(p_partkey) AS first FROM (SELECT p_partkey, list_filter([CASE WHEN p_size % 7 = 0 THEN 'missing:title' END, CASE WHEN try_cast('2024-02-' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS DATE) IS NULL THEN 'bad:date' END,
  CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22') THEN 'unknown:market' END], lambda x: x IS NOT NULL) AS problems FROM part) GROUP BY 1
""")
def manifest_problems(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of files as CSV, read with a schema of text and checked field by field; what is wrong with each row is told,
    and rows are kept."""
    path = f"{shared_folder(spark)}/manifest"
    title = F.when(F.col("p_size") % 7 != 0, F.col("p_name"))
    date = F.concat(F.lit("2024-02-"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    load(spark, d, "part").select("p_partkey", title.alias("title"), date.alias("date"), F.col("p_brand").alias("market")).write.option("header", "true").csv(path)
    rows = spark.read.option("header", "true").schema("p_partkey bigint, title string, date string, market string").csv(path)
    known = F.col("market").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22")
    wrong = F.array_compact(F.array(
        F.when(F.col("title").isNull(), "missing:title"), F.when(F.try_to_date("date", "yyyy-MM-dd").isNull(), "bad:date"), F.when(~known, "unknown:market")
    ))
    return rows.groupBy(wrong.alias("problems")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
