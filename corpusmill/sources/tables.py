"""Readers of the given tables and of the file formats that feed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A metric observation as the spool writes it, one JSON object a line.
OBSERVATION = T.StructType(
    [
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("host", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("states", T.MapType(T.StringType(), T.StringType())),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines spool in tall form (observed_at, host, scope, subject, metric, value, state), and the lines
    that could not be read. Half-written lines are rejects, metrics without a finite value are dropped one by one."""
    rows = spark.read.schema(OBSERVATION).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = rows.where("_corrupt is null and observed_at is not null")
    keys = ["observed_at", "host", "scope", "subject"]
    values = good.select(*keys, F.explode("metrics").alias("metric", "value")).where("value is not null and not isnan(value) and abs(value) < double('Infinity')")
    states = good.select(*keys, F.explode("states").alias("metric", "state")).where("state is not null")
    tall = values.withColumn("state", F.lit(None).cast("string")).unionByName(states.withColumn("value", F.lit(None).cast("double")))
    return tall, rows.where("_corrupt is not null or observed_at is null")


def settled_files(spark: SparkSession, root: str, suffixes: list[str], settle_seconds: int) -> DataFrame:
    """path, modified, size of files under root with one of the suffixes that have not changed for a while."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    wanted = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin([s.lower() for s in suffixes])
    return files.where(wanted & (F.col("modified") <= F.current_timestamp() - F.make_interval(secs=F.lit(settle_seconds))))


def sidecars(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """JSON sidecar records over a closed set of fields, with the problems of each: unreadable, or fields without value."""
    schema = ", ".join(f"{k} {v}" for k, v in fields.items())
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true").json(path)
    missing = [F.when(F.col(k).isNull(), F.lit(f"missing:{k}")) for k in fields]
    problems = F.array_compact(F.array(F.when(F.col("_corrupt").isNotNull(), F.lit("unreadable")), *missing))
    return rows.withColumn("problems", problems).drop("_corrupt")
