"""Conversation prefix trie (operator 12).

A conversation is the sequence of its turns' digests; every distinct beginning is a node. Conversations are sorted by
their sequence, so that a node's members are neighbours, and cut into shards of at most SHARD of them. A shard indexes
(position, turn) to a bitset of its conversations and goes depth first: a node's members, intersected with the postings
of the turns that its members have next, are its children; popcounts, lowest bits and the bits without a next turn give
members, smallest member and ends. A shard knows from its neighbours' sequences, by two numbers, which of its nodes they
share. Every measure is a sum or a minimum over shards: a node counts as a child, and its text once against saved
tokens, in the first shard that has it, as a leaf in the last. So only nodes on a border are merged, one row a shard,
however many conversations begin alike.

Turns are ordered by turn (null first), ties by digest; every row is a turn, repeated ones too. Null roles and texts are
empty, rows without conv_id belong to no conversation. A conversation is one row of 24 bytes a turn, so that one of
millions of turns is held whole by a task, its texts aren't. An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, small_batches, table

#: Bytes of a turn's digest; conversations and turns of a shard (one conversation may have more turns).
WIDE, SHARD, TURNS = 16, 2048, 65_536
#: Border nodes that are broadcast to their children; of more, copies that children look up.
BORDER, SALTS = 50_000, 16


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (hex), chars: what the trie needs of each turn; texts go no further."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.substring(whole, 1, 2 * WIDE).alias("digest"), F.length(text).cast("long").alias("chars")
    )


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of turn, digest, chars in order)."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "digest", "chars")))
    return digested(conversations).groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """As sequences, each conversation c beginning with the first crc32(c) % 6 turns of conversation c - c % 100. A
    hundred conversations share a beginning, so that they are shuffled by it at once and no join is needed."""
    block = F.col("conv_id") - F.col("conv_id") % 100
    turns = digested(conversations).withColumn("block", block).repartition("block")
    listed = turns.groupBy("block", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("turns"))
    head = F.max(F.when(F.col("conv_id") == F.col("block"), F.slice("turns", 1, 5))).over(Window.partitionBy("block"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    own = F.expr("slice(turns, h + 1, size(turns))")
    begin = F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(turns, 1, 0)"))
    return listed.select("conv_id", "turns", head.alias("head"), h.alias("h")).select("conv_id", F.concat(begin, own).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDE
    differs = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differs.argmax()) // WIDE


def path_keys(path: bytes, deepest: int) -> list[bytes]:
    """Names of the nodes on a path, from the root to a depth, that any shard gives them."""
    name, keys = hashlib.blake2b(digest_size=16), []
    for d in range(deepest + 1):
        keys.append(name.copy().digest())
        name.update(path[d * WIDE : (d + 1) * WIDE])
    return keys


Conversation = tuple[int, bytes, list[int]]  # conv_id, sequence, chars


def shard_nodes(shard: list[Conversation], before: int, behind: int) -> list[tuple]:
    """The nodes of neighbours in order of their sequences. before and behind: turns in common with what stands before
    and behind the shard, -1 where nothing does.

    Rows: key and parent_key (only of nodes that other shards may have), parent_conv_id, conv_id, depth, n_convs,
    n_children, n_leaves, saved_tokens, ends."""
    first, last = shard[0], shard[-1]
    old, on = path_keys(first[1], before), path_keys(last[1], behind)
    rows = sorted(shard, key=lambda c: c[0])
    paths = [[c[1][i : i + WIDE] for i in range(0, len(c[1]), WIDE)] for c in rows]
    at_first, at_last = (1 << next(i for i, c in enumerate(rows) if c is x) for x in (first, last))
    postings: dict[tuple[int, bytes], int] = defaultdict(int)
    longer: dict[int, int] = defaultdict(int)  # depth: who has a turn there
    for i, path in enumerate(paths):
        bit = 1 << i
        for d, turn in enumerate(path):
            postings[d, turn] |= bit
            longer[d] |= bit
    # Depth first: members, depth, parent's place in `nodes`.
    nodes: list[list] = []
    stack = [((1 << len(rows)) - 1, 0, -1)]
    while stack:
        members, d, parent = stack.pop()
        low = (members & -members).bit_length() - 1
        n, chars = members.bit_count(), rows[low][2][d - 1] if d else 0
        was = d <= before and bool(members & at_first)
        goes_on = d <= behind and bool(members & at_last)
        key = old[d] if was else on[d] if goes_on else None
        rest = members & longer[d]
        place = len(nodes)
        # low, depth, parent, members, new children, leaves, saved tokens, ends, key, is new
        nodes.append([low, d, parent, n, 0, int(not rest and not goes_on), n * chars - (0 if was else chars), members & ~longer[d], key, not was])
        while rest:
            i = (rest & -rest).bit_length() - 1
            child = rest & postings[d, paths[i][d]]
            rest ^= child
            stack.append((child, d + 1, place))
    for low, d, parent, n, children, leaves, saved, ends, key, new in reversed(nodes):
        if parent >= 0:
            up = nodes[parent]
            up[4] += new
            up[5] += leaves
            up[6] += saved
    out = []
    for low, d, parent, n, children, leaves, saved, ends, key, new in nodes:
        up = nodes[parent] if parent >= 0 else None
        names = []
        while ends:
            i = (ends & -ends).bit_length() - 1
            names.append(str(rows[i][0]))
            ends &= ends - 1
        here = None if up is None or up[8] else rows[up[0]][0]
        out.append((key, up and up[8], here, rows[low][0], d, n, children, leaves, saved, ",".join(names) or None))
    return out


NODES = (
    "key binary, parent_key binary, parent_conv_id bigint, conv_id bigint, depth bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends string, part int, shard bigint"
)
TYPES = pa.schema(
    [(n, pa.binary()) for n in ("key", "parent_key")]
    + [(n, pa.int64()) for n in ("parent_conv_id", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends", pa.string()), ("part", pa.int32()), ("shard", pa.int64())]
)


def shards(rows: Iterable[Conversation], size: int) -> Iterator[list[Conversation]]:
    """Neighbours together, at most size conversations and about TURNS turns."""
    some, turns = [], 0
    for row in rows:
        if some and (len(some) >= size or turns + len(row[2]) > TURNS):
            yield some
            some, turns = [], 0
        some.append(row)
        turns += len(row[2])
    if some:
        yield some


def sharded_nodes(ordered: DataFrame, borders: dict[int, tuple[int, int]], size: int) -> DataFrame:
    """Nodes of all shards of conversations that lie in order in their partitions; borders: of each partition, the turns
    that its first and its last conversation have in common with the neighbour's."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = -1, -1

        def rows() -> Iterator[Conversation]:
            nonlocal part
            for batch in batches:
                for c, p, seq, chars in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "part", "seq", "chars"))):
                    part = p
                    yield c, seq, chars

        # A shard can be worked on when the next one's first conversation is known.
        waiting, shard = None, 0
        for following in chain(shards(rows(), size), [None]):
            if waiting is not None:
                before = borders[part][0] if shard == 0 else before
                behind = common(waiting[-1][1], following[0][1]) if following else borders[part][1]
                nodes = shard_nodes(waiting, before, behind)
                for k in range(0, len(nodes), 10_000):
                    some = nodes[k : k + 10_000]
                    columns = [*zip(*some), [part] * len(some), [shard] * len(some)]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, TYPES.types)], schema=TYPES)
                before, shard = behind, shard + 1
            waiting = following

    small_batches()
    return ordered.mapInArrow(walk, NODES)


def partition_borders(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """Of each partition with rows: turns in common before its first and behind its last conversation, -1 for none. The
    driver gets three numbers a partition."""
    ends = ordered.groupBy("part").agg(
        F.min(F.struct("seq", "conv_id")).alias("first"), F.max(F.struct("seq", "conv_id")).alias("last")
    )

    @F.arrow_udf("int")
    def in_common(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([-1 if x is None or y is None else common(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    by_part = Window.orderBy("part")  # a row for each partition
    pairs = ends.select(
        "part", F.lag("last.seq").over(by_part).alias("l"), F.col("first.seq").alias("f"),
        F.col("last.seq").alias("e"), F.lead("first.seq").over(by_part).alias("n"),
    )
    found = pairs.select("part", in_common("l", "f").alias("before"), in_common("e", "n").alias("behind"))
    return {r.part: (r.before, r.behind) for r in found.collect()}


def border_ends(border: DataFrame) -> DataFrame:
    """key, ends_sha256 of border nodes at which conversations end: shards' lists digested one behind the other, so
    that no task holds more than one shard's."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, hashlib.sha256()
        done: list[tuple[bytes, str]] = []
        for batch in batches:
            for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ends.encode())
                else:
                    sha.update(b"," + ends.encode())
            if done:
                yield pa.record_batch([pa.array(c) for c in zip(*done)], ["key", "ends_sha256"])
                done = []
        if key is not None:
            yield pa.record_batch([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], ["key", "ends_sha256"])

    lists = border.where("ends is not null").select("key", "part", "shard", "ends")
    return lists.repartition("key").sortWithinPartitions("key", "part", "shard").mapInArrow(digest, "key binary, ends_sha256 string")


def with_parents(rows: DataFrame, border: DataFrame, bound: int) -> DataFrame:
    """rows, whose parents lie on a border, with parent_conv_id. At most bound border nodes are broadcast; of more, each is
    there SALTS times, since one of them, such as the root, may have nearly all rows for children."""
    ids = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    if ids.count() > bound:
        ids = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int")
        joined = rows.withColumn("salt", salt).join(ids, ["parent_key", "salt"]).drop("salt")
    else:
        joined = rows.join(F.broadcast(ids), "parent_key")
    return joined.withColumn("parent_conv_id", F.col("found")).drop("found")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(convs: DataFrame, size: int = SHARD, bound: int = BORDER) -> DataFrame:
    """One row for each node of the trie over convs (conv_id, turns), as sequences gives them: COLUMNS. size and bound
    decide how the work is cut, not its result."""
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), ""))
    chars = F.transform("turns", lambda t: t.chars)
    flat = convs.select("conv_id", seq.alias("seq"), chars.alias("chars"))
    ordered = flat.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    ordered = checkpointed(ordered.withColumn("part", F.spark_partition_id()))
    nodes = checkpointed(sharded_nodes(ordered, partition_borders(ordered), size))
    sha = F.sha2(F.coalesce("ends", F.lit("")).cast("binary"), 256)
    inner = nodes.where("key is null").withColumn("ends_sha256", sha)
    rows = nodes.where("key is not null")
    border = rows.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    border = border.join(border_ends(rows), "key", "left")
    border = checkpointed(border.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))))
    border = border.withColumn("parent_conv_id", F.lit(None).cast("long"))
    either: Column = F.col("parent_key").isNull()
    children = inner.where(~either).select("parent_key", *COLUMNS).unionByName(border.where(~either).select("parent_key", *COLUMNS))
    tops = inner.where(either).select(COLUMNS).unionByName(border.where(either).select(COLUMNS))
    return tops.unionByName(with_parents(children, border, bound).select(COLUMNS))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie over all rebuilt conversations, one row for each node."""
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


OP12_SQL = """
with crc_table as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t),
turns as (
  select conv_id, digest, chars, row_number() over (partition by conv_id order by turn nulls first, digest) as k
  from (select conv_id, turn, length(coalesce(text, '')) as chars,
          left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) as digest
        from conversations where conv_id is not null)),
convs as (
  select conv_id, conv_id - conv_id % 100 as base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 as h
  from (select distinct conv_id from turns), crc_table),
picked as (
  select c.conv_id, t.k, t.digest, t.chars from convs c join turns t on t.conv_id = c.base and t.k <= c.h
  union all
  select c.conv_id, t.k, t.digest, t.chars from convs c join turns t on t.conv_id = c.conv_id and t.k > c.h),
whole as (select conv_id, list(digest order by k) as path, list(chars order by k) as sizes from picked group by conv_id),
rebuilt as (select c.conv_id, coalesce(path, []) as path, coalesce(sizes, []) as sizes from convs c left join whole w using (conv_id)),
steps as (
  select conv_id, d, len(path) = d as ends, md5(d || ':' || array_to_string(path[1:d], '')) as node,
    case when d > 0 then md5((d - 1) || ':' || array_to_string(path[1:d - 1], '')) end as parent,
    case when d > 0 then sizes[d] else 0 end as chars
  from (select *, unnest(range(len(path) + 1)) as d from rebuilt)),
nodes as (
  select node, any_value(d) as depth, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs,
    (count(*) - 1) * any_value(chars) as saved,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from steps group by node),
kids as (select parent as node, count(*) as n from nodes where parent is not null group by parent),
below as (
  select s.node, sum(n.saved) as saved_tokens, count(*) filter (k.n is null) as n_leaves
  from nodes n join steps s on s.conv_id = n.conv_id and s.d <= n.depth left join kids k on k.node = n.node
  group by s.node)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n, 0) as n_children,
  b.n_leaves, b.saved_tokens::bigint as saved_tokens, n.ends_sha256
from nodes n join below b using (node) left join kids k using (node) left join nodes p on p.node = n.parent
"""
