"""Names of a table in texts: an automaton over all names at once, broadcast while they are few, sharded beyond."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.frames import checkpointed
from corpusmill.plans.registry import query
from corpusmill.sources.tables import load

#: Names that one automaton holds; texts that a task of the sharded way looks through.
NAMES, TEXTS = 200_000, 5000
FOUND = "array<struct<kind:string,name:string,value:long>>"


def comparable(text: Column) -> Column:
    """Lower case, without white space: in this form names are looked for in texts."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def automaton(names: Iterable[tuple[str, str, int]]) -> ahocorasick.Automaton:
    """Of (kind, name, value); a name of several kinds has several entries, one of several values of a kind the least."""
    machine = ahocorasick.Automaton()
    entries: dict[str, dict[str, int]] = {}
    for kind, name, value in names:
        of = entries.setdefault(name, {})
        of[kind] = min(value, of.get(kind, value))
    for name, of in entries.items():
        if name:
            machine.add_word(name, (name, tuple(of.items())))
    if len(machine):
        machine.make_automaton()
    return machine


def longest(machine: ahocorasick.Automaton, text: str | None) -> list[dict]:
    """The longest name of each kind that a text holds; of equally long ones the least."""
    best: dict[str, tuple[int, str, int]] = {}
    if text and len(machine):
        for name, of in {found for _, found in machine.iter(text)}:
            for kind, value in of:
                if kind not in best or (-len(name), name) < best[kind][:2]:
                    best[kind] = (-len(name), name, value)
    return [{"kind": k, "name": name, "value": value} for k, (_, name, value) in sorted(best.items())]


def mentions(machine: ahocorasick.Automaton, text: str | None) -> list[tuple[int, str]]:
    """(start, name) of names that don't overlap: from the left, at each place the longest."""
    return [(end - len(name) + 1, name) for end, (name, _) in machine.iter_long(text)] if text and len(machine) else []


@lru_cache(maxsize=2)
def shared_automaton(names: Broadcast) -> ahocorasick.Automaton:
    """The automaton of broadcast names; one for each worker, which keeps its broadcasts as objects."""
    return automaton(names.value)


def longest_names(texts: DataFrame, names: DataFrame, bound: int = NAMES) -> DataFrame:
    """id, kind, name, value: the longest of names (kind, name, value) of each kind in each of texts (id, norm). Up to
    bound names are broadcast. More are cut into shards by their first two characters; each block of texts meets each
    shard in a task that builds the shard's automaton, so that texts travel once for each shard."""
    given = checkpointed(names.where("name is not null and name <> '' and value is not null").select("kind", "name", F.col("value").cast("long").alias("value")).distinct())
    n = given.count()
    if n <= bound:
        table = given.toArrow()  # at most bound rows
        shared = texts.sparkSession.sparkContext.broadcast(list(zip(*(table[c].to_pylist() for c in ("kind", "name", "value")))))

        @F.arrow_udf(FOUND)
        def find(batch: pa.Array) -> pa.Array:
            machine = shared_automaton(shared)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("value", pa.int64())]))
            return pa.array([longest(machine, t.as_py()) for t in batch], kind)

        return texts.select("id", F.inline(find("norm")))
    shards = -(-n // bound)
    cut = given.withColumn("shard", F.pmod(F.xxhash64(F.substring("name", 1, 2)), F.lit(shards)).cast("int"))
    blocks = max(1, -(-texts.count() // TEXTS))
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = texts.select("id", "norm", F.pmod(F.xxhash64("id", "norm"), F.lit(blocks)).cast("int").alias("block"), spread(shards).alias("shard"))
    right = cut.withColumn("block", spread(blocks))

    def look(some: pa.Table, words: pa.Table) -> pa.Table:
        machine = automaton(zip(*(words[c].to_pylist() for c in ("kind", "name", "value"))))
        rows = [(i, x["kind"], x["name"], x["value"]) for i, t in zip(some["id"].to_pylist(), some["norm"].to_pylist()) for x in longest(machine, t)]
        columns = zip(*rows) if rows else ((), (), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()))], ["id", "kind", "name", "value"])

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(look, "id long, kind string, name string, value long")
    best = F.min(F.struct((-F.length("name")).alias("l"), "name", "value")).alias("x")
    return found.groupBy("id", "kind").agg(best).select("id", "kind", "x.name", "x.value")


def known_names(spark: SparkSession, d: str) -> DataFrame:
    """kind, name, value: names of parts, nations and regions and the first two words of benchmark items, as the texts
    are compared. A name that stands for several rows has the least key."""
    tables = (("part", "p_name", "p_partkey"), ("nation", "n_name", "n_nationkey"), ("region", "r_name", "r_regionkey"))
    rows = [load(spark, d, t).select(F.lit(t).alias("kind"), comparable(F.col(name)).alias("name"), F.col(key).cast("long").alias("value")) for t, name, key in tables]
    item = F.regexp_extract("text", r"^\s*(\S+\s+\S+)", 1)
    rows.append(load(spark, d, "benchmark").select(F.lit("benchmark").alias("kind"), comparable(item).alias("name"), F.col("item_id").cast("long").alias("value")))
    colour = F.regexp_extract("p_name", r"^(\S+)", 1)
    rows.append(load(spark, d, "part").select(F.lit("colour").alias("kind"), comparable(colour).alias("name"), F.col("p_partkey").cast("long").alias("value")))
    both = rows[0]
    for other in rows[1:]:
        both = both.unionByName(other)
    return both.where("name <> ''").groupBy("kind", "name").agg(F.min("value").alias("value"))


@query(r"""
WITH names AS (SELECT kind, regexp_replace(lower(name), '\s+', '', 'g') AS name, min(value) AS value FROM (
  SELECT 'part' AS kind, p_name AS name, p_partkey AS value FROM part UNION ALL SELECT 'nation', n_name, n_nationkey FROM nation UNION ALL SELECT 'region', r_name, r_regionkey FROM region
  UNION ALL SELECT 'benchmark', regexp_extract(text, '^\s*(\S+\s+\S+)', 1), item_id FROM benchmark UNION ALL SELECT 'colour', regexp_extract(p_name, '^(\S+)', 1), p_partkey FROM part) GROUP BY 1, 2),
texts AS (SELECT doc_id, regexp_replace(lower(text), '\s+', '', 'g') AS norm FROM documents)
SELECT doc_id, kind, name, value FROM texts JOIN names ON contains(norm, name) WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, kind ORDER BY length(name) DESC, name) = 1
""")
def longest_match(spark: SparkSession, d: str) -> DataFrame:
    """The longest known name of each kind that a document contains."""
    texts = load(spark, d, "documents").select(F.col("doc_id").alias("id"), comparable(F.col("text")).alias("norm"))
    return longest_names(texts, known_names(spark, d)).withColumnRenamed("id", "doc_id")
