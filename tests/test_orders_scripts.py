"""Order scores against counting pairs, script detection, results that take each other's place, boilerplate by join."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import orders, textfns
from corpusmill.operators import text as text_operators
from corpusmill.sources import sinks


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 200, 1000])
def test_pairs_equal_counting(n):
    r = random.Random(n)
    places = np.array([r.randrange(max(1, n // 2)) for _ in range(n)], np.int64)
    streams = np.array([r.randrange(3) for _ in range(n)], np.int64)
    pairs = list(combinations(range(n), 2))
    same = [(i, j) for i, j in pairs if streams[i] == streams[j]]
    rise = lambda ps: sum(int(places[i] < places[j]) for i, j in ps)
    assert orders.order_counts(places, streams) == (len(pairs), rise(pairs), len(same), rise(same))


def test_a_long_order_takes_no_square(spark):
    rows = spark.range(200_000).agg(F.array_agg(F.struct(F.col("id").alias("place"), F.lit("x").alias("stream"))).alias("t"))
    got = rows.select(orders.order_score(F.array_sort("t")).alias("x")).select("x.*", orders.tau(F.col("x.pairs"), F.col("x.concordant")).alias("tau")).first()
    assert tuple(got) == (199_999 * 100_000,) * 4 + (1.0,)


def test_orders_of_null_empty_and_unnamed_streams(spark):
    rows = spark.createDataFrame([(0, None), (1, []), (2, [(1, None), (2, None), (3, "a")]), (3, [(5, "a"), (5, "a")])], "i int, t array<struct<place:int,stream:string>>")
    got = {r["i"]: tuple(r["x"]) for r in rows.select("i", orders.order_score(F.col("t")).alias("x")).collect()}
    assert got == {0: (0, 0, 0, 0), 1: (0, 0, 0, 0), 2: (3, 3, 1, 1), 3: (1, 0, 1, 0)}


def test_scripts(spark):
    texts = {"国务院发布新规定": True, "國務院發布新規定": False, "恒大": False, "会议": True, "会": False, "這份報告" * 30 + "恒耀与": False, "": False, None: False, "English 国务院发": True}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", textfns.looks_simplified(F.col("t")).alias("x"))
    assert {r["t"]: r["x"] for r in df.collect()} == texts
    assert 2000 < len(textfns.SIMPLIFIED) < 6763 and not set("國務院發布新規定台灣") & set(textfns.SIMPLIFIED)


def test_a_result_is_whole_or_as_before(spark, tmp_path):
    path = f"{tmp_path}/r"
    read = lambda: sorted(x["id"] for x in spark.read.schema("id long").json(path).collect())
    size = sinks.write_result(spark.range(3), path)
    assert read() == [0, 1, 2] and size > 20
    with pytest.raises(ValueError, match="bytes"):
        sinks.write_result(spark.range(1000), path, 100)
    assert read() == [0, 1, 2]
    sinks.write_result(spark.range(5, 6), path)
    assert read() == [5] and [p.name for p in tmp_path.iterdir()] == ["r"]


def test_boilerplate_by_join_equals_by_broadcast(spark):
    r = random.Random(1)
    common = ["this line stands in many documents of a source", "and so does this other one of the same"]
    rows = [(i, r.choice(["a", "b"]), "\n".join(r.sample(common, r.randint(0, 2)) + [f"own line number {i} {r.random()}" for _ in range(r.randint(1, 4))])) for i in range(80)]
    rows += [(3, "a", "another text of the same id\n" + common[0]), (500, None, common[0]), (501, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one, other = (sorted(map(tuple, text_operators.stripped(df, bound).collect()), key=repr) for bound in (50_000, 0))
    assert one == other and len(one) == len(rows)
