"""Layers and reachability on random graphs; names against plain search, broadcast and sharded."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import names
from corpusmill.plans import graphs


def brute_layers(nodes, deps):
    pending = {n: set(deps.get(n, ())) - {n} for n in nodes}
    layer, left, depth = {}, set(nodes), 0
    while front := {n for n in left if not pending[n] & left}:
        for n in front:
            layer[n] = (depth, False)
        left -= front
        depth += 1
    for n in left:
        layer[n] = (max([layer[d][0] + 1 for d in pending[n] - left], default=0), True)
    return layer


def upstream(n, deps):
    seen, stack = set(), list(deps.get(n, ()))
    while stack:
        x = stack.pop()
        if x not in seen and x != n:
            seen.add(x)
            stack += deps.get(x, ())
    return seen


@pytest.mark.parametrize("small", [0, 20])
@pytest.mark.parametrize("seed, back", [(4, 0), (5, 15)])
def test_layers_by_fronts_that_are_not_sent(spark, monkeypatch, seed, back, small):
    """Rounds with a large front leave its edges behind; small ones that follow find the others."""
    monkeypatch.setattr(graphs, "SMALL", small)
    r = random.Random(seed)
    edges = {(b, a) for a, b in (sorted(r.sample(range(90), 2)) for _ in range(150))} | {tuple(sorted(r.sample(range(90), 2))) for _ in range(back)}
    deps = {}
    for node, ancestor in edges:
        deps.setdefault(node, set()).add(ancestor)
    got = graphs.layers(spark.range(90).withColumnRenamed("id", "node"), spark.createDataFrame(list(edges), "node long, ancestor long"))
    assert {x["node"]: (x["layer"], x["cyclic"]) for x in got.collect()} == brute_layers(range(90), deps)


@pytest.mark.parametrize("seed, back", [(1, 0), (2, 3), (3, 15)])
def test_layers_and_causes_on_random_graphs(spark, seed, back):
    r = random.Random(seed)
    n = 120
    edges = {(b, a) for a, b in (sorted(r.sample(range(n), 2)) for _ in range(200))} | {tuple(sorted(r.sample(range(n), 2))) for _ in range(back)}
    deps = {}
    for node, ancestor in edges:
        deps.setdefault(node, set()).add(ancestor)
    df = spark.createDataFrame([*edges, *list(edges)[:5], (7, 7), (None, 3)], "node long, ancestor long")
    nodes = spark.range(n).withColumnRenamed("id", "node")
    got = {x["node"]: (x["layer"], x["cyclic"]) for x in graphs.layers(nodes, df).collect()}
    assert got == brute_layers(range(n), deps) and (back == 0) == (not any(c for _, c in got.values()))
    down = set(r.sample(range(n), 9))
    hit = graphs.reached(nodes.where(F.col("node").isin(list(down))), df).where("low <> node or high <> node").collect()
    assert {x["node"] for x in hit} == {x for x in range(n) if upstream(x, deps) & down}


def test_layers_of_a_chain_and_of_nothing(spark):
    chain = spark.range(1, 45).select(F.col("id").alias("node"), (F.col("id") - 1).alias("ancestor"))
    nodes = spark.range(45).withColumnRenamed("id", "node")
    assert all(x["layer"] == x["node"] and not x["cyclic"] for x in graphs.layers(nodes, chain).collect())
    none = spark.createDataFrame([], "node long, ancestor long")
    assert graphs.layers(none.select("node"), none).count() == 0
    assert {tuple(x) for x in graphs.layers(nodes, none).collect()} == {(i, 0, False) for i in range(45)}


TEXTS = ["redapplepie and red", "apple", "", None, "applepi", "東京都庁", "xx", "piepie"]
NAMES = [("fruit", "apple", 3), ("fruit", "apple", 2), ("dish", "applepie", 7), ("dish", "pie", 8), ("colour", "red", 1), ("place", "東京", 4), ("place", "東京都", 5), ("place", "京都庁", 6), ("dish", "", 9), ("dish", None, 1), ("none", "zzz", 1), ("twin", "apple", 11)]


@pytest.mark.parametrize("bound", [1000, 3])
def test_longest_names_of_each_kind(spark, monkeypatch, bound):
    monkeypatch.setattr(names, "TEXTS", 3)
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, norm string")
    table = spark.createDataFrame(NAMES, "kind string, name string, value long")
    got = sorted(map(tuple, names.longest_names(texts, table, bound).collect()))
    want = []
    for i, t in enumerate(TEXTS):
        for kind in sorted({k for k, _, _ in NAMES}):
            held = sorted((-len(n), n, v) for k, n, v in NAMES if k == kind and n and n in (t or ""))
            if held:
                want.append((i, kind, held[0][1], held[0][2]))
    assert got == sorted(want)


def test_mentions_go_from_the_left_and_take_the_longest():
    machine = names.automaton((k, n, v) for k, n, v in NAMES if n)
    assert names.mentions(machine, "redapplepiepie") == [(0, "red"), (3, "applepie"), (11, "pie")]
    assert names.mentions(machine, "東京都庁") == [(0, "東京都")] and names.mentions(names.automaton([]), "a") == []
