"""Queries against their SQL on small tables of odd rows."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.plans import catalog


@pytest.fixture
def both(spark, tmp_path):
    """The rows of a query and of its SQL over the tables given."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, df in tables.items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
            con.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        df = catalog.queries()[name](spark, str(tmp_path))
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
        return sorted(map(tuple, df.collect()), key=repr), sorted(want, key=repr)

    return run


@pytest.mark.parametrize("name", ["quote_anchor", "reanchor_counts", "takeaway_rows"])
def test_a_quote_that_overlaps_itself_is_not_found_once(spark, both, name):
    texts = ["Head\nsome line\n" + "To " * 40 + "end\ntail of it", "aaaaa bbbbb aaaaa\nx\naaaaa bbbbb", "One line of some length.\nAnother line of some length.\n" + "ab" * 13, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, quality int")
    got, want = both(name, documents=docs, labels=labels)
    assert got == want
    if name == "quote_anchor":
        tiers = {(r[0], r[1]): r[2] for r in got}
        assert tiers[0, 3] is None and tiers[0, 1] == "exact" and tiers[2, 2] == "normalized"


def test_trading_words_are_whole_words_of_any_script(spark, both):
    texts = ["buy it", "orderé", "éorder", "x_sell", "我想buy股", "please Sell.", "order", "order\n", "ordeŕ now", "sell2", "buý", None, ""]
    rows = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string")
    got, want = both("rule_router", conversations=rows)
    assert got == want
    assert [r[0] for r in got if r[2] == "trade"] == [0, 5, 6, 7]


def test_every_administrator_without_a_factor_is_told(spark, both):
    people = spark.range(200).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment"), (F.col("id") % 2).alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"))
    people = people.unionByName(spark.createDataFrame([(300, "BUILDING", 2, 1.0), (301, "FURNITURE", 2, 1.0)], people.schema))
    nations = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "n_nationkey long, n_name string")
    got, want = both("second_factor_adoption", customer=people, nation=nations)
    assert sorted((r[0], r[-1]) for r in got if r[-1] is not None) == sorted(("ab"[i % 2], i) for i in range(200) if i % 3)
    assert got == want and ("c", 2, 1, 1, 1, None) in got


def order_tables(spark):
    """Lines whose order, supplier, part or brand is missing, without a quantity, of repeated suppliers and old dates."""
    day = lambda n: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=n)
    lines = [(i % 40, i % 11, (i * 7) % 26, float(i % 5), float(100 + i % 17)) for i in range(600)]
    lines += [(1000, 1, 2, 1.0, 1.0), (1, 1, 900, 1.0, 1.0), (1, 900, 2, 1.0, 1.0), (2, 3, None, 1.0, 1.0), (3, 10, 4, 2.0, None), (4, 2, 3, None, 2.0), (39, 12, 30, 1.0, 2.0), (50, 13, 2, 1.0, 1.0)]
    return {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double"),
        "orders": spark.createDataFrame([(i, day(i * 13), f"{i * i % 5 + 1}-X") for i in range(40)], "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string"),
        "supplier": spark.createDataFrame([(i, i) for i in range(25)] + [(3, 2), (4, None), (30, None), (7, 7)], "s_suppkey long, s_nationkey int"),
        "part": spark.createDataFrame([(i, f"name {i}", None if i == 10 else f"b{i % 4}") for i in range(12)] + [(12, "late", "only"), (13, "none", "unread")], "p_partkey long, p_name string, p_brand string"),
    }


@pytest.mark.parametrize("name", ["coverage_states", "instrument_overview", "consensus_latest", "catalog"])
def test_signals_of_odd_orders(spark, both, name):
    got, want = both(name, **order_tables(spark))
    assert got == want and got
    if name == "coverage_states":
        states = {r[0]: r[-1] for r in got}
        assert states["unread"] == states[None] == "pending" and set(states) == {"b0", "b1", "b2", "b3", "only", "unread", None}


@pytest.mark.parametrize("name, most", [("coverage_states", 2), ("instrument_overview", 0), ("consensus_rating", 0), ("stance_page", 0)])
def test_signals_are_read_once(spark, tmp_path, name, most):
    """Lines are left in the plan only where they are read for the first time."""
    for table, df in order_tables(spark).items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    plan = catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_suppkey" in line for line in plan.splitlines()) <= most
