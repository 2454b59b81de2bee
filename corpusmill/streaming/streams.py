"""Structured Streaming over the event table: tumbling, sliding and session windows, de-duplication, running quotas.

Queries run to the end of the available input and return what the sink then holds, so that they can be compared with a
batch over the same rows. Sinks and checkpoints lie in the shared folder that the cluster names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.plans.frames import shared_root
from corpusmill.plans.registry import query
from corpusmill.sources.tables import load


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, with an event time that takes a watermark."""
    schema = load(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame) -> DataFrame:
    """Runs a stream to the end of its input and returns the rows that it appended. A window is appended once, when the
    watermark has passed its end, and its state dropped; windows that later rows may still change are not there yet."""
    root = shared_folder(stream.sparkSession)
    write = stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    write.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


#: The watermark that a stream of all events ends with.
CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= {CLOSED}")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    rows = event_stream(spark, d).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return drained(rows).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""
SELECT * FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, count(*) AS n FROM events, (VALUES (0), (1)) AS t(k) GROUP BY 1) WHERE start + INTERVAL 1 HOUR <= {CLOSED}
""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Hours that begin every half hour."""
    rows = event_stream(spark, d).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return drained(rows).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query(f"""
WITH gaps AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
marked AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
SELECT user_id, min(ts) AS start, count(*) AS n FROM marked GROUP BY user_id, s HAVING max(ts) + INTERVAL 1 HOUR <= {CLOSED}
""")
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    rows = event_stream(spark, d).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return drained(rows).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every event delivered twice, kept once by its natural key."""
    rows = event_stream(spark, d).select("event_id", "user_id", "ts")
    both = rows.union(rows).withWatermark("ts", "31 days").dropDuplicatesWithinWatermark(["event_id"])
    return drained(both.select("event_id", "user_id"))


@query("""
SELECT user_id, CAST(least(count(*), 40) AS BIGINT) AS counted, CAST(greatest(count(*) - 40, 0) AS BIGINT) AS over FROM events GROUP BY 1
""")
def stream_quota(spark: SparkSession, d: str) -> DataFrame:
    """A counter of each user with a limit, as state that lives across batches."""

    def charge(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counted, over = state.get if state.exists else (0, 0)
        for frame in frames:
            taken = min(len(frame), 40 - counted)
            counted, over = counted + taken, over + len(frame) - taken
        state.update((counted, over))
        yield pd.DataFrame({"user_id": [key[0]], "counted": [counted], "over": [over]})

    rows = event_stream(spark, d).select("user_id").groupBy("user_id")
    live = rows.applyInPandasWithState(charge, "user_id long, counted long, over long", "counted long, over long", "update", GroupStateTimeout.NoTimeout)
    root = shared_folder(spark)
    save: Callable[[DataFrame, int], None] = lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{root}/out")
    live.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    latest = spark.read.parquet(f"{root}/out").groupBy("user_id").agg(F.max_by(F.struct("counted", "over"), "batch").alias("x"))
    return latest.select("user_id", "x.counted", "x.over")
