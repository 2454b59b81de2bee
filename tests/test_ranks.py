"""Exact percentiles, with all values of a group in one window or dealt by ranges."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.plans import ranks, running

SHARES = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}


@pytest.mark.parametrize("few", [200_000, 0])
@pytest.mark.parametrize("keys", [[], ["g"], ["g", "h"]])
def test_percentiles_equal_sql(spark, monkeypatch, few, keys):
    monkeypatch.setattr(running, "FEW", few)
    r = random.Random(3)
    rows = [(r.choice(["a", "a", "a", "b", None]), i % 2, r.choice([None, 5.0, float(r.randrange(50)), r.random()])) for i in range(3000)] + [("one", 0, 1.5), ("none", 0, None)]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(7)
    con = duckdb.connect()
    con.execute("create table t (g varchar, h int, v double)")
    con.executemany("insert into t values (?, ?, ?)", rows)
    by = f"group by {', '.join(keys)}" if keys else ""
    for function, sql in ((ranks.nearest_rank, "quantile_disc"), (ranks.interpolated, "quantile_cont")):
        got = sorted((tuple(x[c] for c in (*keys, *SHARES)) for x in function(df, keys, "v", SHARES).collect()), key=repr)
        take = ", ".join([*keys, *(f"{sql}(v, {p})" for p in SHARES.values())])
        want = sorted(con.execute(f"select {take} from t where v is not null {by}").fetchall(), key=repr)
        assert len(got) == len(want) and all(a == pytest.approx(b) if isinstance(a, float) else a == b for x, y in zip(got, want) for a, b in zip(x, y))


def test_no_task_has_more_than_its_share(spark, monkeypatch):
    """One group of different doubles: dealt by ranges, none has much more than another."""
    monkeypatch.setattr(running, "FEW", 1000)
    seen = []
    keep = running.checkpointed
    monkeypatch.setattr(running, "checkpointed", lambda df: seen.append(keep(df)) or seen[-1])
    df = spark.range(40_000).select(F.lit("x").alias("g"), F.rand(1).alias("v"))
    ranks.interpolated(df, ["g"], "v", {"m": 0.5}).collect()
    dealt = next(d for d in seen if "_part" in d.columns)
    sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    assert len(sizes) >= 2 and max(sizes) <= 2 * 40_000 / len(sizes)


@pytest.mark.parametrize("few", [200_000, 0])
def test_running_sums_of_a_hot_key(spark, monkeypatch, few):
    monkeypatch.setattr(running, "FEW", few)
    r = random.Random(8)
    rows = [(r.choice(["hot", "hot", "hot", "cold", None]), i, r.randrange(100)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i long, x long").withColumn("one", F.lit(1))
    got = {x["i"]: (x["run"], x["place"], x["_total_run"]) for x in running.running(df, ["g"], ["i"], {"run": "x", "place": "one"}).collect()}
    want, sums = {}, {}
    for g, i, x in rows:
        s, n = sums.get(g, (0, 0))
        sums[g] = (s + x, n + 1)
        want[i] = sums[g]
    assert got == {i: (*want[i], sums[g][0]) for g, i, _ in rows}
    assert running.running(df.limit(0), ["g"], ["i"], {"run": "x"}).count() == 0
