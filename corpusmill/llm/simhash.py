"""SimHash near-duplicates (operator 9) by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some value differs from each of them in at most r. So every
distinct fingerprint stands for its ball: the 1 + 64 + 2016 variants within r = 2 bits. Fingerprints that share a
variant collide; each is paired with the least one of its variant, the pairs are verified by counting the bits in which
they differ, and a spanning forest of them is kept: a link for each fingerprint instead of one for each pair, so that
dense groups stay cheap and every link given is one within the radius.

Variants are shuffled by their first bits. A fingerprint travels once to each range of variants that its ball
reaches, 79 for 12 bits, and the variants inside a range are made there, in numpy, never more than LIMIT at a time:
a range that holds too many is halved at its next bit until it fits. A range of more than HOT fingerprints is dealt
to as many tasks as its next bits name, and beyond that takes longer in proportion to its fingerprints. Nothing is
capped.

Components come from alternating stars (large, then small), each a grouped minimum and a join, with a checkpoint for
every round. Null texts count as empty; texts without words have fingerprint 0 and are linked like any other. Copies
share one fingerprint, so they are linked before the search begins. Rows that repeat a doc_id keep a row each. Rows
with a null doc_id take part and lend no id: a component of such rows alone has a null component_id. Long texts are
hashed whole, block by block. Extra columns of docs travel inside a struct or are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import likeness
from .common import checkpointed, table, text_udf
from .stars import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Variants that one task holds at a time.
LIMIT = 1 << 21
#: Shingles hashed at a time.
BLOCK = 1 << 16
#: Fingerprints beyond which a range is dealt to more tasks, and the bits that name them.
HOT, MORE = 50_000, 8


def simhash(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    first = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    last = ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(first), BLOCK):
        h = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(first[i : i + BLOCK], last[i : i + BLOCK])]
        ones += np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > len(first)).tolist()))


def fingerprint(text: Column, width: int = SHINGLE) -> Column:
    """The fingerprint of each text as a long of the same 64 bits."""

    @text_udf("long")
    def simhash_text(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t, width) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return simhash_text(text)


def _masks(bits: int, flips: int) -> np.ndarray:
    """All values of at most `flips` ones among the lowest `bits` bits."""
    one = [1 << i for i in range(bits)]
    out = [0]
    if flips > 0:
        out += one
    if flips > 1:
        out += [a | b for i, a in enumerate(one) for b in one[:i]]
    return np.array(out, np.uint64)


def _ball(flips: int, bits: int) -> int:
    return 1 + (flips > 0) * bits + (flips > 1) * bits * (bits - 1) // 2


def collisions(fps: np.ndarray, left: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index of a fingerprint, index of the least one that shares a variant with it). left: how many of the
    lowest `bits` bits each may still flip; the bits above are settled."""
    todo = [(np.arange(len(fps)), left, bits)]
    while todo:
        at, flips, free = todo.pop()
        if len(at) < 2:
            continue
        if free and sum(int((flips == f).sum()) * _ball(f, free) for f in (0, 1, 2)) > LIMIT:
            bit = (fps[at] >> np.uint64(free - 1)) & np.uint64(1)
            for side in (0, 1):
                same = bit == side
                keep = same | (flips > 0)
                todo.append((at[keep], (flips - ~same)[keep], free - 1))
            continue
        variants, owners = [], []
        for f in (0, 1, 2):
            own = at[flips == f]
            if len(own):
                masks = _masks(free, f)
                variants.append((fps[own][:, None] ^ masks[None, :]).ravel())
                owners.append(np.repeat(own, len(masks)))
        v, who = np.concatenate(variants), np.concatenate(owners)
        low = np.uint64((1 << free) - 1) if free < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
        v &= low
        order = np.argsort(v)
        v, who = v[order], who[order]
        new = np.concatenate(([True], v[1:] != v[:-1]))
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(who, np.flatnonzero(new))[group]  # fps are sorted: least index, least fingerprint
        hit = who != least
        if hit.any():
            pairs = np.unique(who[hit] * np.int64(len(fps)) + least[hit])
            yield pairs // len(fps), pairs % len(fps)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b) of indices below n, enough to connect whatever all of them connect: one for each index that
    is not the least of its component."""
    root, kept = np.arange(n), [(a[:0], b[:0])]
    while True:
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        apart = high != low
        if not apart.any():
            return tuple(np.concatenate(x) for x in zip(*kept))
        a, b, high, low = (x[apart] for x in (a, b, high, low))
        high, first = np.unique(high, return_index=True)  # each root joins one lesser root: no cycles
        kept.append((a[first], b[first]))
        root[high] = low[first]
        while not (root[root] == root).all():
            root = root[root]


def links(fps: DataFrame, prefix: int | None = None) -> DataFrame:
    """Distinct links (a, b, bits), b < a, of the distinct fingerprints fp (long) that differ in `bits`, at most RADIUS,
    bits: enough of them to connect whatever any pair within RADIUS would. prefix: bits that name a range of variants; it
    grows with the number of fingerprints, up to 24, so that a range's share stays bounded."""
    if prefix is None:
        prefix = min(24, max(8, (fps.count() // 64).bit_length()))
    flips, rest = RADIUS // 2, 64 - prefix
    masks = lambda bits: F.explode(F.array(*[F.lit(int(m)) for m in _masks(bits, flips)]))
    sent = fps.select("fp", masks(prefix).alias("mask"))
    sent = sent.select("fp", F.shiftrightunsigned("fp", rest).bitwiseXOR(F.col("mask")).alias("range"), (flips - F.bit_count("mask")).alias("left"))
    hot = [r["range"] for r in sent.groupBy("range").count().where(F.col("count") > HOT).select("range").collect()]  # few: each holds many
    more = sent.where(F.col("range").isin(hot)).select("*", masks(MORE).alias("mask")).where(F.bit_count("mask") <= F.col("left"))
    next_bits = F.shiftrightunsigned("fp", rest - MORE).bitwiseAND(F.lit((1 << MORE) - 1)).bitwiseXOR(F.col("mask"))
    dealt = sent.where(~F.col("range").isin(hot)).select("fp", "range", F.lit(-1).cast("long").alias("part")) if hot else sent.select("fp", "range", F.lit(-1).cast("long").alias("part"))
    if hot:
        dealt = dealt.union(more.select("fp", "range", next_bits.cast("long").alias("part")))

    def within(batch: pa.Table) -> pa.Table:
        fp = np.sort(batch["fp"].to_numpy().view(np.uint64))
        a = b = np.zeros(0, np.int64)
        if len(fp) > 1:
            named, part, free = np.uint64(batch["range"][0].as_py()), batch["part"][0].as_py(), rest
            if part >= 0:
                named, free = named << np.uint64(MORE) | np.uint64(part), rest - MORE
            spent = np.bitwise_count((fp >> np.uint64(free)) ^ named)
            found, waiting = [(a, b)], 0
            for pair in collisions(fp, flips - spent.astype(np.int64), free):
                found.append(pair)
                waiting += len(pair[0])
                if waiting > LIMIT:  # thinned at times, so that what a crowded range finds stays small
                    found, waiting = [forest(len(fp), *(np.concatenate(x) for x in zip(*found)))], 0
            a, b = forest(len(fp), *(np.concatenate(x) for x in zip(*found)))
            near = np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS
            a, b = a[near], b[near]
        return pa.table({"a": fp[a].view(np.int64), "b": fp[b].view(np.int64)})

    found = dealt.groupBy("range", "part").applyInArrow(within, "a long, b long")
    found = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return found.select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("bits"))


def groups(marked: DataFrame) -> DataFrame:
    """fp, root, component_id of each distinct fingerprint of marked (doc_id, fp)."""
    least = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    roots = components(links(least.select("fp")).select("a", "b"))
    named = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    return named.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long), component_id of every row of docs (doc_id, text)."""
    marked = checkpointed(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")))
    return marked.join(groups(marked), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns) without near duplicates: of each component the document of
    least doc_id, one row of it if rows repeat; of a component without any doc_id one row. Documents are linked by their
    fingerprints and by a likeness of 0.8 or more of their sets of five words."""
    rows = docs.select(F.struct("*").alias("doc"))
    told = docs.select("doc_id", F.xxhash64("text").alias("t"), fingerprint(F.col("text")).alias("fp"), likeness.described(F.col("text")).alias("of"))
    marked = checkpointed(told.select("doc_id", "t", "fp", "of.*"))
    of = checkpointed(marked.select("set", "fp").distinct())
    least = of.groupBy("set").agg(F.min("fp").alias("low"))
    # fingerprints of one set are linked, whatever the ball hashing says of them
    same = of.join(least, "set").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    roots = components(links(checkpointed(of.select("fp").distinct())).select("a", "b").union(same))
    start = checkpointed(least.join(roots, F.col("low") == F.col("node"), "left").select("set", F.coalesce("root", "low").alias("root")))
    found = likeness.grouped(docs, marked, start)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lone"), F.coalesce("doc_id", F.lit(0)).alias("id"), "t")).alias("k")
    kept = marked.groupBy("set").agg(first).join(found, "set").groupBy("root").agg(F.min("k").alias("k")).select("k.*")
    keys = ["lone", "id", "t"]
    named = rows.select("doc", F.col("doc.doc_id").isNull().alias("lone"), F.coalesce("doc.doc_id", F.lit(0)).alias("id"), F.xxhash64("doc.text").alias("t"))
    one = named.join(kept, keys, "left_semi").withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("t")))
    return one.where("n = 1").select("doc.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the near-duplicate component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
