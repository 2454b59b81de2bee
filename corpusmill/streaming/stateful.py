"""Stateful operators over streams: texts that arrive in pieces, throttled tallies, counters whose sink may fail.

State is kept by key in RocksDB and moved on by event-time timers, so that results depend on the rows and their times, not
on how they fall into micro-batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusmill.plans.registry import query
from corpusmill.sources.stored import put_in_place
from corpusmill.sources.tables import load

from .streams import CLOSED, event_stream, shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for as long as a stream runs; what was there before comes back."""
    keys = {k: k.replace("_", ".") for k in values}
    before = {k: spark.conf.get(k, None) for k in keys.values()}
    for k, v in values.items():
        spark.conf.set(keys[k], v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(stream: DataFrame, root: str) -> DataFrame:
    """Runs a stateful stream to the end of its input and returns what it appended."""
    write = stream.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    with settings(stream.sparkSession, **{"spark_sql_streaming_stateStore_providerClass": ROCKS}):
        write.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


# --- pieces of a text, up to a mark that may lie across their borders


def released(held: str, piece: str, mark: str) -> tuple[str, str, bool]:
    """(out, held, found) when a piece follows what is held: what comes before the mark may go; without it, all but a tail
    that the mark may begin with."""
    text = held + piece
    at = text.find(mark)
    if at >= 0:
        return text[:at], "", True
    keep = next((k for k in range(min(len(mark) - 1, len(text)), 0, -1) if text.endswith(mark[:k])), 0)
    return text[: len(text) - keep], text[len(text) - keep :], False


#: Groups that texts are dealt to by the digest of their id. A state call costs as much as the work on many pieces, so that
#: a group's open texts are read and written together, once for each micro-batch that brings some of their pieces.
SHARDS = 4096


class UpToMark(StatefulProcessor):
    """Lets the pieces of texts pass, each text's in the order of their numbers, up to a mark. Pieces that come too early
    wait. What is held back goes out with the last piece, or, if that never comes, `patience` after the latest one. A key is
    a group of texts; its one timer is that of the text that is due first."""

    STATE = "text_id string, next int, held string, found boolean, latest bigint, waiting array<struct<seq: int, piece: string, last: boolean>>"
    SCHEMA = "text_id string, seq int, out string, found boolean"

    def __init__(self, mark: str, patience_ms: int = 600_000):
        self.mark, self.patience = mark, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("texts", self.STATE)

    def opened(self) -> dict[str, list]:
        """What the state has of the group's texts."""
        return {t: [following, held, found, latest, {x[0]: (x[1], x[2]) for x in early or []}] for t, following, held, found, latest, early in self.state.get()}

    def due(self, texts: dict[str, list]) -> int | None:
        """When the first of the texts is due."""
        return min(t[3] for t in texts.values()) + self.patience if texts else None

    def keep(self, texts: dict[str, list]) -> None:
        if texts:
            self.state.put([(t, *x[:4], [(seq, *y) for seq, y in sorted(x[4].items())]) for t, x in texts.items()])
        else:
            self.state.clear()

    def passed(self, name: str, text: list) -> tuple[list[tuple], bool]:
        """The rows that a text lets go of now, and whether it ends with them."""
        following, held, found, _, waiting = text
        out, last = [], False
        while following in waiting and not last:
            piece, last = waiting.pop(following)
            if not found:
                shown, held, found = released(held, piece, self.mark)
                if last and not found:
                    shown, held = shown + held, ""
                if shown or found:
                    out.append((name, following, shown, found))
            following += 1
        text[:3] = following, held, found
        return out, last

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        texts = self.opened()
        before, moved = self.due(texts), {}
        for frame in rows:
            at = frame["ts"].astype("datetime64[ms]").astype("int64")
            for name, seq, piece, last, ms in zip(*(frame[c].tolist() for c in ("text_id", "seq", "piece", "last")), at.tolist()):
                text = moved[name] = texts.setdefault(name, [0, "", False, ms, {}])
                text[3] = max(text[3], ms)
                if seq >= text[0]:  # else it came twice
                    text[4][seq] = (piece or "", bool(last))
        out = []
        for name, text in moved.items():
            gone, last = self.passed(name, text)
            out += gone
            if last:
                del texts[name]
        self.keep(texts)
        if (after := self.due(texts)) != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        if out:
            yield pd.DataFrame(out, columns=["text_id", "seq", "out", "found"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        texts, now = self.opened(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        ended = {name: text for name, text in texts.items() if text[3] + self.patience <= now}
        texts = {name: text for name, text in texts.items() if name not in ended}
        self.keep(texts)
        if texts:
            self.handle.registerTimer(self.due(texts))
        out = [(name, following, held, False) for name, (following, held, found, _, _) in ended.items() if held and not found]
        if out:
            yield pd.DataFrame(out, columns=["text_id", "seq", "out", "found"])

    def close(self) -> None:
        pass


def up_to_mark(pieces: DataFrame, mark: str, patience_ms: int = 600_000) -> DataFrame:
    """text_id, seq, out, found: what may be shown of texts that stream in as pieces (text_id, seq, piece, last, ts, with a
    watermark on ts). The outs of a text, by seq, join to what stands before the mark."""
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("text_id"), F.lit(SHARDS)))
    return dealt.groupBy("shard").transformWithStateInPandas(UpToMark(mark, patience_ms), UpToMark.SCHEMA, "Append", "EventTime")


#: The mark that the query looks for, the length of its pieces, files that these arrive in, and texts whose last piece is lost.
MARK, PIECE, FILES = ".\n", 64, 4


@query(f"""
SELECT conv_id, turn, md5(shown) AS digest, length(shown) AS n_chars, found FROM (
  SELECT conv_id, turn, strpos(whole, '.' || chr(10)) > 0 AS found, split_part(whole, '.' || chr(10), 1) AS shown FROM (
    SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN left(text, {PIECE} * CAST(ceil(length(text) / {PIECE}.0) - 1 AS BIGINT)) ELSE text END AS whole FROM conversations WHERE text <> ''))
WHERE shown <> '' OR found
""")
def stream_up_to_mark(spark: SparkSession, d: str) -> DataFrame:
    """Messages that arrive in pieces, out of order and over several micro-batches, up to the first full stop at a line's
    end. Of every seventh conversation the last pieces never arrive; a timer lets go of what is held."""
    root = shared_folder(spark)
    rows = load(spark, d, "conversations").where("text <> ''").select(F.concat_ws(":", "conv_id", "turn").alias("text_id"), "conv_id", "text")
    n = F.ceil(F.length("text") / float(PIECE)).cast("int")
    cut = rows.select("text_id", "conv_id", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq"))
    pieces = cut.select("text_id", "seq", F.substring(F.col("text"), PIECE * F.col("seq") + 1, F.lit(PIECE)).alias("piece"), (F.col("seq") == F.col("n") - 1).alias("last"), start.alias("ts"), "conv_id")
    pieces = pieces.where(~(F.col("last") & (F.col("conv_id") % 7 == 0))).drop("conv_id")
    pieces.withColumn("file", F.pmod(F.xxhash64("text_id", "seq"), F.lit(FILES))).repartition("file").write.partitionBy("file").parquet(f"{root}/pieces")
    late = spark.createDataFrame([("end", 0, "", True, 1_700_000_000 + 10_000_000)], "text_id string, seq int, piece string, last boolean, at long")
    late.select("text_id", "seq", "piece", "last", F.timestamp_seconds("at").alias("ts"), F.lit(FILES).alias("file")).write.mode("append").partitionBy("file").parquet(f"{root}/pieces")
    schema = "text_id string, seq int, piece string, last boolean, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/pieces/file=*").withWatermark("ts", "20 days")
    shown = run(up_to_mark(stream, MARK), root)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "out"))), lambda x: x["out"]), "")
    key = F.split("text_id", ":")
    joined = shown.groupBy("text_id").agg(whole.alias("shown"), F.bool_or("found").alias("found"))
    return joined.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), F.md5(F.col("shown").cast("binary")).alias("digest"), F.length("shown").cast("long").alias("n_chars"), "found")


# --- throttled tallies


class ThrottledTally(StatefulProcessor):
    """Counts by name, flushed `every` after the first count that is not out yet. So many names are counted apart; those that
    come when these are taken are counted under none. Rows are taken in the order of their times, once the watermark has
    passed them."""

    STATE = "waiting array<struct<ts: bigint, id: bigint, name: string>>, since bigint, names array<string>, counts array<bigint>, others bigint"
    SCHEMA = "tally string, since timestamp, name string, n long"

    def __init__(self, every_ms: int = 60_000, max_names: int = 256):
        self.every, self.most = every_ms, max_names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tally", self.STATE)

    def moved_on(self, key, waiting: list, watermark: int) -> Iterator[pd.DataFrame]:
        """Takes what the watermark has passed and flushes what is due."""
        stored = self.state.get() if self.state.exists() else ([], None, [], [], 0)
        waiting = sorted([tuple(x) for x in stored[0] or []] + waiting)
        since, others = stored[1], stored[4] or 0
        counts = dict(zip(stored[2] or [], stored[3] or []))
        out: list[tuple] = []

        def flush() -> None:
            rows = sorted(counts.items()) + ([(None, others)] if others else [])
            out.extend((key[0], pd.Timestamp(since, unit="ms"), name, n) for name, n in rows)
            counts.clear()

        done = 0
        for ts, _, name in waiting:
            if ts > watermark:
                break
            done += 1
            if since is not None and ts >= since + self.every:
                flush()
                since, others = None, 0
            if since is None:
                since = ts
            if name is None or (name not in counts and len(counts) >= self.most):
                others += 1
            else:
                counts[name] = counts.get(name, 0) + 1
        if since is not None and watermark >= since + self.every:
            flush()
            since, others = None, 0
        waiting = waiting[done:]
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if waiting or since is not None:
            self.state.update((waiting, since, list(counts), list(counts.values()), others))
            due = [since + self.every] if since is not None else []
            self.handle.registerTimer(max(min(due + [ts for ts, _, _ in waiting[:1]]), watermark + 1))
        else:
            self.state.clear()
        if out:
            yield pd.DataFrame(out, columns=["tally", "since", "name", "n"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(ts.value // 1_000_000), int(i), None if name is None or name != name else str(name)) for f in rows for ts, i, name in zip(f["ts"], f["id"], f["name"])]
        yield from self.moved_on(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.moved_on(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def throttled(rows: DataFrame, every_ms: int = 60_000, max_names: int = 256) -> DataFrame:
    """tally, since, name, n from rows (tally, id, name, ts with a watermark): a row for each name of each flush, by name, the
    unnamed last. since: when the flush's first row was. A tally's rows go one by one, so that a tally should be what one
    server counts of one kind."""
    return rows.groupBy("tally").transformWithStateInPandas(ThrottledTally(every_ms, max_names), ThrottledTally.SCHEMA, "Append", "EventTime")


@query(f"""
WITH RECURSIVE e AS (SELECT event_type || '/' || (user_id % 4) AS tally, date_trunc('milliseconds', ts) AS ts, event_id, user_id FROM events),
w AS (SELECT tally, min(ts) AS since FROM e GROUP BY 1 UNION ALL SELECT w.tally, (SELECT min(e.ts) FROM e WHERE e.tally = w.tally AND e.ts >= w.since + INTERVAL 6 HOUR) FROM w WHERE w.since IS NOT NULL),
spans AS (SELECT * FROM w WHERE since IS NOT NULL AND since + INTERVAL 6 HOUR <= date_trunc('milliseconds', {CLOSED})),
inside AS (SELECT s.tally, s.since, e.user_id, min((e.ts, e.event_id)) AS first, count(*) AS n FROM spans s JOIN e ON e.tally = s.tally AND e.ts >= s.since AND e.ts < s.since + INTERVAL 6 HOUR GROUP BY 1, 2, 3),
named AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY tally, since ORDER BY first) <= 3 THEN CAST(user_id AS VARCHAR) END AS name FROM inside)
SELECT tally, since, name, CAST(sum(n) AS BIGINT) AS n FROM named GROUP BY ALL
""")
def stream_throttled_tally(spark: SparkSession, d: str) -> DataFrame:
    """Events of a kind and a server, tallied by user: flushed six hours after the first, three users by name."""
    ts = F.date_trunc("millisecond", "ts").alias("ts")
    rows = event_stream(spark, d).select(F.concat_ws("/", "event_type", (F.col("user_id") % 4).cast("string")).alias("tally"), F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("name"), ts)
    out = run(throttled(rows.withWatermark("ts", "1 hour"), 6 * 3_600_000, 3), shared_folder(spark))
    return out.select("tally", F.col("since").cast("timestamp_ntz").alias("since"), "name", "n")


# --- counters with a sink that may fail


class CounterLedger:
    """A sink for foreachBatch that adds up counters by key, once for each batch, whatever fails in between: a batch's sums
    are written beside the ledger and put in place under the batch's number as one rename. A batch that is run again, since
    its stream failed before or after that, replaces its own entry. Totals are the sum over entries."""

    def __init__(self, path: str, keys: list[str], subject: str | None = None):
        self.path, self.keys, self.subject = path, keys, subject

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        subjects = [F.countDistinct(self.subject).alias("subjects")] if self.subject else []
        fresh = f"{self.path}-new-{uuid.uuid4().hex}"
        rows.groupBy(*self.keys).agg(F.count("*").alias("hits"), *subjects).write.parquet(fresh)
        spark = rows.sparkSession
        spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(self.path))
        if not put_in_place(spark, fresh, f"{self.path}/batch={batch_id}"):
            raise OSError(f"batch {batch_id} could not be put into the ledger")

    def totals(self, spark: SparkSession, schema: str) -> DataFrame:
        """keys, hits, and the greatest number of subjects that one batch had; schema: of the keys."""
        subjects = ", subjects long" if self.subject else ""
        entries = spark.read.schema(f"{schema}, hits long{subjects}, batch int").parquet(self.path)
        most = [F.max("subjects").alias("subjects")] if self.subject else []
        return entries.groupBy(*self.keys).agg(F.sum("hits").alias("hits"), *most)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS hits FROM events GROUP BY 1, 2")
def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters by day and kind, over a ledger that takes each batch once: the sink fails after it has written a batch, the
    stream is started again, and nothing is counted twice or lost."""
    root = shared_folder(spark)
    ledger = CounterLedger(f"{root}/ledger", ["day", "event_type"])
    failed: list[int] = []

    def once_broken(rows: DataFrame, batch_id: int) -> None:
        ledger(rows, batch_id)
        if not failed:
            failed.append(batch_id)
            raise ConnectionError("the sink went away after the write")

    rows = event_stream(spark, d).select(F.to_date("ts").alias("day"), "event_type")
    for _ in range(2):
        writing = rows.writeStream.foreachBatch(once_broken).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        try:
            writing.awaitTermination()
        except Exception:
            if not failed:
                raise
    return ledger.totals(spark, "day date, event_type string")
