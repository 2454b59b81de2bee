"""Stateful streams and tailing sources: the same result however rows fall into micro-batches, and after failures."""

import os
import random
import time

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.sources import tail
from corpusmill.streaming import stateful

MARK = "[[END]]"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="[END]x", max_size=5), max_size=12), st.sampled_from(["", MARK]))
def test_pieces_let_go_what_the_whole_has_before_the_mark(pieces, mark):
    pieces = [*pieces, mark[:3], mark[3:], "tail"]
    out, held, found = "", "", False
    for p in pieces:
        if not found:
            text, held, found = stateful.released(held, p, MARK)
            out += text
            assert MARK not in out and len(held) < len(MARK)
    assert out + held == "".join(pieces).split(MARK)[0] and found == (MARK in "".join(pieces))


def streamed(spark, path, rows, schema, files, per_batch, order):
    """rows as a stream of so many files."""
    rows = list(rows)
    order.shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files] or rows[:0], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


@pytest.mark.parametrize("files, per_batch", [(1, 1), (5, 1), (5, 2)])
def test_texts_up_to_a_mark_whatever_the_batches(spark, tmp_path, files, per_batch):
    texts = {"a": "one two [[END]] three", "b": "no mark at all [[EN", "c": "[[END]]", "d": "x" * 40 + "[[[END]]", "e": "lost end [[E", "f": "ab"}
    rows, at = [], 0
    for key, text in texts.items():
        cut = [text[i : i + 3] for i in range(0, len(text), 3)]
        for i, piece in enumerate(cut):
            at += 1
            last = i == len(cut) - 1 and key != "e"  # of e the end is never said
            rows += [(key, i, piece, last, at)] * (1 + (i == 1))  # some come twice
    shifted = [(k, i, p, last, 1_700_000_000 + at) for k, i, p, last, at in rows]
    schema = "text_id string, seq int, piece string, last boolean, at long"
    stream = streamed(spark, f"{tmp_path}/in", shifted, schema, files, per_batch, random.Random(files))
    spark.createDataFrame([("z", 0, "", True, 1_700_000_000 + 90_000)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    stream = stream.withColumn("ts", F.timestamp_seconds("at")).drop("at").withWatermark("ts", "2 hours")
    got = stateful.run(stateful.up_to_mark(stream, MARK, 3_600_000), str(tmp_path)).orderBy("text_id", "seq").collect()
    shown = {k: "".join(r["out"] for r in got if r["text_id"] == k) for k in texts}
    assert shown == {k: t.split(MARK)[0] for k, t in texts.items()}
    assert {r["text_id"] for r in got if r["found"]} == {"a", "c", "d"}


class Calls:
    """A handle whose state is a list, with what was asked of it."""

    def __init__(self):
        self.rows, self.timers, self.asked = [], set(), []

    def getListState(self, name, schema):
        return self

    def get(self):
        self.asked.append("get")
        return iter(list(self.rows))

    def put(self, rows):
        self.asked.append("put")
        self.rows = rows

    def clear(self):
        self.asked.append("clear")
        self.rows = []

    def registerTimer(self, at):
        self.asked.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.asked.append("delete")
        self.timers.remove(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at

    def getCurrentWatermarkInMs(self):
        return self.at + 1


def test_texts_of_a_group_share_their_state_calls_but_not_their_timers():
    handle, processor = Calls(), stateful.UpToMark(MARK, 1000)
    processor.init(handle)

    def rows(seq, last, *of):
        return pd.DataFrame([(f"t{i}", seq, f"{i} text [[E" if seq == 0 else "ND]] rest", last, pd.Timestamp(i, unit="ms")) for i in of], columns=["text_id", "seq", "piece", "last", "ts"])

    take = lambda *frames: [tuple(r) for out in processor.handleInputRows((0,), iter(frames), None) for r in out.itertuples(index=False)]
    assert sorted(take(rows(0, False, *range(100, 200)), rows(0, False, *range(200, 500)))) == [(f"t{i}", 0, f"{i} text ", False) for i in range(100, 500)]
    assert handle.asked == ["get", "put", "register"] and handle.timers == {1100}
    handle.asked.clear()
    assert take(rows(1, True, *range(100, 497))) == [(f"t{i}", 1, "", True) for i in range(100, 497)]
    assert handle.asked == ["get", "put", "delete", "register"] and handle.timers == {1497}
    for due, after in ((1497, {1498}), (1498, {1499}), (1499, set())):
        gone = [tuple(r) for out in processor.handleExpiredTimer((0,), Clock(due), Clock(due)) for r in out.itertuples(index=False)]
        handle.timers.discard(due)  # as Spark does
        assert gone == [(f"t{due - 1000}", 1, "[[E", False)] and handle.timers == after
    assert handle.rows == []


@pytest.mark.parametrize("shards", [1, 2])
def test_texts_of_one_group_stay_apart(spark, tmp_path, monkeypatch, shards):
    monkeypatch.setattr(stateful, "SHARDS", shards)
    texts = {f"t{i}": ("a" * i + ("[[END]] more" if i % 2 else " [[E")) for i in range(12)}
    start = 1_700_000_000
    rows = [(k, i // 5, t[i : i + 5], i + 5 >= len(t) and k != "t4", start + 60 * i) for k, t in texts.items() for i in range(0, len(t), 5)]
    schema = "text_id string, seq int, piece string, last boolean, at long"
    stream = streamed(spark, f"{tmp_path}/in", rows, schema, 3, 1, random.Random(shards))
    spark.createDataFrame([("z", 0, "", True, start + 90_000)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    stream = stream.withColumn("ts", F.timestamp_seconds("at")).drop("at").withWatermark("ts", "2 hours")
    got = stateful.run(stateful.up_to_mark(stream, MARK, 3_600_000), str(tmp_path)).orderBy("text_id", "seq").collect()
    assert {k: "".join(r["out"] for r in got if r["text_id"] == k) for k in texts} == {k: t.split(MARK)[0] for k, t in texts.items()}


def plain_tally(rows, every, most, end):
    """The rows of one tally in order, one by one."""
    out, since, counts, others = [], None, {}, 0
    for ts, _, name in sorted(rows):
        if since is not None and ts >= since + every:
            out += [(since, n, c) for n, c in sorted(counts.items())] + ([(since, None, others)] if others else [])
            since, counts, others = None, {}, 0
        since = ts if since is None else since
        if name is None or (name not in counts and len(counts) >= most):
            others += 1
        else:
            counts[name] = counts.get(name, 0) + 1
    if since is not None and since + every <= end:
        out += [(since, n, c) for n, c in sorted(counts.items())] + ([(since, None, others)] if others else [])
    return out


@pytest.mark.parametrize("files", [1, 6])
def test_tallies_whatever_the_batches(spark, tmp_path, files):
    r = random.Random(4)
    start = 1_700_000_000
    rows = sorted((r.choice("xy"), i, r.choice(["p", "q", "r", "s", None]), start + r.randrange(2000)) for i in range(250))
    schema = "tally string, id long, name string, at long"
    late = start + 10_000
    stream = streamed(spark, f"{tmp_path}/in", rows, schema, files, 1, r)
    spark.createDataFrame([("end", 999, "p", late)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    stream = stream.withColumn("ts", F.timestamp_seconds("at")).drop("at").withWatermark("ts", "1 hour")
    got = stateful.run(stateful.throttled(stream, 60_000, 2), str(tmp_path)).collect()
    have = sorted((x["tally"], int(x["since"].timestamp()), x["name"] or "", x["n"]) for x in got)
    want = sorted((t, since, name or "", n) for t in "xy" for since, name, n in plain_tally([(at, i, name) for tt, i, name, at in rows if tt == t], 60, 2, late))
    assert have == want


@pytest.mark.parametrize("when", ["before", "between", "after"])
def test_a_ledger_counts_each_batch_once(spark, tmp_path, monkeypatch, when):
    """The sink fails before it writes, between write and rename, or after; the stream is started again."""
    schema = "day int, user string"
    rows = [(i % 3, f"u{i % 7}") for i in range(100)]
    stream = streamed(spark, f"{tmp_path}/in", rows, schema, 4, 1, random.Random(1))
    ledger, failures = stateful.CounterLedger(f"{tmp_path}/ledger", ["day"], "user"), [2, 5]
    calls = []

    def sink(df, batch_id):
        calls.append(batch_id)
        broken = len(calls) in failures
        if broken and when == "before":
            raise ConnectionError
        if broken and when == "between":
            with monkeypatch.context() as m:
                m.setattr(stateful, "put_in_place", lambda *a: False)
                ledger(df, batch_id)
        ledger(df, batch_id)
        if broken:
            raise ConnectionError

    for _ in range(3):
        run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        try:
            run.awaitTermination()
        except Exception as error:
            assert "Error" in str(error)
    assert len(calls) == 6 and sorted(set(calls)) == [0, 1, 2, 3]
    got = {r["day"]: (r["hits"], r["subjects"]) for r in ledger.totals(spark, "day int").collect()}
    assert {d: h for d, (h, _) in got.items()} == {d: sum(x == d for x, _ in rows) for d in range(3)}
    assert all(0 < s <= 7 for _, s in got.values())


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(ZeroDivisionError), stateful.settings(spark, spark_sql_shuffle_partitions="3"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        1 // 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


# --- tails


def lines(reader, a, b):
    return [x[2] for p in reader.partitions(a, b) for x in reader.read(p)]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_a_spool_gives_every_whole_line_once(tmp_path_factory, data):
    """Appends of any bytes, read between them with any budget; a task's share may end anywhere in a line."""
    root = tmp_path_factory.mktemp("spool")
    reader = tail.SpoolReader(str(root), data.draw(st.integers(1, 40)))
    offset, got = reader.initialOffset(), []
    whole = {"a": b"", "b": b""}
    for _ in range(data.draw(st.integers(1, 5))):
        name, more = data.draw(st.sampled_from("ab")), data.draw(st.lists(st.sampled_from([b"x", b"long line", b"\n", "é".encode(), b"\xff"]), max_size=8))
        whole[name] += b"".join(more)
        with open(root / name, "ab") as f:
            f.write(b"".join(more))
        for _ in range(data.draw(st.integers(0, 3))):
            now = reader.latestOffset()
            got, offset = got + lines(reader, offset, now), now
    while (now := reader.latestOffset()) != offset:
        got, offset = got + lines(reader, offset, now), now
    assert sorted(got) == sorted(x for w in whole.values() for x in w.decode("utf-8", "replace").split("\n")[:-1])


def test_a_replaced_or_shortened_file_is_read_from_its_beginning(tmp_path):
    path = tmp_path / "a"
    path.write_bytes(b"first line of the old file\nsecond\n")
    reader = tail.SpoolReader(str(tmp_path), 1 << 20)
    one = reader.latestOffset() if reader.initialOffset() == {} else None
    path.write_bytes(b"another file of the same name, and longer\nthan the old one\n")
    two = reader.latestOffset()
    assert lines(reader, one, two) == ["another file of the same name, and longer", "than the old one"]
    path.write_bytes(b"another\n")
    assert lines(reader, two, reader.latestOffset()) == ["another"]


def test_a_spool_stream_goes_on_where_it_was(spark, tmp_path):
    """Half a line is there when the stream stops; a new stream with the same checkpoint gets it whole."""
    spool = tmp_path / "spool"
    spool.mkdir()
    spark.dataSource.register(tail.SpoolSource)

    def follow():
        stream = spark.readStream.format("spool").option("path", str(spool)).option("maxBytes", "50").load()
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
        return sorted(r["value"] for r in spark.read.schema("path string, at long, value string").parquet(f"{tmp_path}/out").collect())

    (spool / "a").write_bytes(b"one\ntwo\nthr")
    assert follow() == ["one", "two"]
    with open(spool / "a", "ab") as f:
        f.write(b"ee\n" + b"".join(b"line %d\n" % i for i in range(20)))
    (spool / "b").write_bytes(b"other\n")
    for _ in range(5):
        got = follow()
    assert got == sorted(["one", "two", "three", "other", *(f"line {i}" for i in range(20))])


def test_settled_files_come_once_for_each_change(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    old = time.time() - 1000

    def put(name, text, at):
        (folder / name).write_text(text)
        os.utime(folder / name, (at, at))

    put("a.PDF", "a", old)
    put("deep/b.docx", "b", old + 1)
    put("c.txt", "c", old)
    put("fresh.pdf", "d", time.time() + 5)
    reader = tail.SettledReader(str(folder), (".pdf", ".docx"), 60, True)
    found = lambda a, b: [x for p in reader.partitions(a, b) for x in reader.read(p)]
    start = reader.initialOffset()
    one = reader.latestOffset()
    first = found(start, one)
    assert [os.path.basename(x[0]) for x in first] == ["a.PDF", "b.docx"] and found(one, reader.latestOffset()) == []
    put("a.PDF", "longer", old + 50)
    again = found(one, reader.latestOffset())
    assert [os.path.basename(x[0]) for x in again] == ["a.PDF"] and again[0][3] != first[0][3]
    assert tail.SettledReader(str(tmp_path / "none"), ("",), 60, True).latestOffset() == start
