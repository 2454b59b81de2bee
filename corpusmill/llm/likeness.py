"""Exact near duplicates for the pipeline: groups of documents linked by a Jaccard likeness of 0.8 or more of their sets of
five-word shingles, by a prefix-filter join.

A set of n shingles overlaps any set as like as that in at least ceil(0.8 n) shingles, so two such sets share one of the
first n - ceil(0.8 n) + 1 in whatever order all sets are in. The order is by hash, but shingles that a part of the sets
shows to be in many come last. It decides how much work there is, not what is found. Sets are grouped by a digest
first, so that copies take part once. First shingles are shuffled by ranges of their hash. Up to RUN sets that share one
are paired with each other; of more, each is paired with three of them first, and once these pairs are verified and the
groups known, the groups' representatives are paired in rounds, and at last only sets of different groups are, spread
over pairs of blocks. So a large group of near copies costs time by its size, not by the square of it, and no link
between groups is lost. Lengths, places in the order and parities of hashed buckets, all bounds that no pair that
belongs breaks, leave few pairs for which the sets themselves are read and compared. A set has about as many buckets as
shingles; parities of a longer set fold to those of a shorter one.

Shingles and sets are told apart by 64-bit hashes. Texts of fewer than five words are one shingle; null texts and texts
without a word have an empty set, like no other. Whole texts are read. Empty tables give no groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpointed, small_or_not, text_udf
from .stars import components

WIDTH, SEED = 5, 42
#: One of so many sets is read to learn which shingles come last, and how many of those there may be.
EVERY, LAST = 32, 100_000
#: Sets of one shingle that are all paired at once, sets of a block beyond that, and rounds among representatives.
RUN, PART, ROUNDS = 48, 1000, 1
#: Shingles that one task compares at a time.
BLOCK = 1 << 22
#: Buckets of parities at least; a power of two.
PARITIES = 1024


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; words as in simhash."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.array([], np.uint64)
    h = np.array([xxh64_intdigest(w, SEED) for w in words], np.uint64)
    width = min(WIDTH, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C17) + h[k : k + n]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def set_id(hashes: np.ndarray) -> int:
    """A digest of a set, as a signed long."""
    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether each bucket of hashes holds an odd number of them: sets differ in as many shingles as bits at least."""
    size = max(PARITIES, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def differing(a: Column, b: Column) -> Column:
    """In how many buckets two sets' parities differ; the longer array, at most twice as long, is folded."""
    n = F.least(F.size(a), F.size(b))
    fold = lambda x: F.when(F.size(x) == n, x).otherwise(F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda p, q: p.bitwiseXOR(q)))
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def least_overlap(n: int) -> int:
    """ceil(0.8 n)."""
    return -(-4 * n // 5)


def described(text: Column) -> Column:
    """set, n, odd (parities) of each text, and some: its shingles if it is of the part that tells the order."""

    @text_udf("struct<set:long,n:int,odd:array<long>,some:array<long>>")
    def shingle_sets(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            h = shingles(t)
            of = set_id(h)
            out.append({"set": of, "n": len(h), "odd": parities(h), "some": h.view(np.int64) if of % EVERY == 0 else None})
        return pa.array(out, pa.struct([("set", pa.int64()), ("n", pa.int32()), ("odd", pa.list_(pa.int64())), ("some", pa.list_(pa.int64()))]))

    return shingle_sets(text)


def first_shingles(text: Column, last: np.ndarray) -> Column:
    """set, n and the first shingles of each text; last: hashes that come last, in order."""
    by = np.argsort(last)
    known = last[by]

    @text_udf("struct<set:long,n:int,first:array<long>>")
    def shingle_prefixes(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            h = shingles(t)
            n, of = len(h), set_id(h)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                late = known[at] == h
                h = np.concatenate((h[~late], last[np.sort(by[at[late]])]))
            out.append({"set": of, "n": n, "first": h[: n - least_overlap(n) + 1].view(np.int64) if n else []})
        return pa.array(out, pa.struct([("set", pa.int64()), ("n", pa.int32()), ("first", pa.list_(pa.int64()))]))

    return shingle_prefixes(text)


def possible(n: np.ndarray, at: np.ndarray, i: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Whether sets i and o, which share the shingles at their places `at`, may be alike: what lies before and behind
    these places bounds what they have in common."""
    most = np.minimum(at[i], at[o]) + np.minimum(n[i] - at[i], n[o] - at[o])
    return 9 * np.minimum(most, np.minimum(n[i], n[o])) >= 4 * (n[i] + n[o])


def paired(h: np.ndarray, sets: np.ndarray, n: np.ndarray, at: np.ndarray, run: int | None = None, apart: list[np.ndarray] | None = None, odd: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of sets that share a shingle and may be alike, with a pivot, the least set that shares it, which names
    pairs that are best compared together; and which rows (after sorting by h, set) are of
    shingles that more than run sets hold: of those, each set is paired with the two least and with the one before it.
    apart: only pairs that differ in all of these count; odd: parities of each row's set, by which pairs that differ too
    much are left out at once. Rows are distinct and sorted."""
    n, at = n.astype(np.int64), at.astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.array([], np.int64)
    size = np.diff(np.append(new, len(h)))
    hot = np.zeros(len(h), bool)
    found = [np.zeros((0, 3), np.int64)]

    def enter(i: np.ndarray, o: np.ndarray, pivot: int) -> None:
        good = possible(n, at, i, o) & (sets[i] != sets[o])
        for kind in apart or ():
            good &= kind[i] != kind[o]
        if odd is not None and good.any():
            i, o = i[good], o[good]
            good = 9 * np.bitwise_count(odd[i] ^ odd[o]).sum(axis=1, dtype=np.int64) <= n[i] + n[o]
        if good.any():
            found.append(np.stack((sets[i][good], sets[o][good], np.full(int(good.sum()), pivot)), axis=1))

    for start, k in zip(new[size > 1].tolist(), size[size > 1].tolist()):
        if run and k > run:
            hot[start : start + k] = True
            x = np.arange(start + 1, start + k)
            for first in (np.full(k - 1, start), np.full(k - 1, start + 1), x - 1):
                enter(np.minimum(first, x), np.maximum(first, x), sets[start])
        else:
            for i in range(start, start + k - 1):
                o = np.arange(i + 1, start + k)
                enter(np.full(len(o), i), o, sets[start])
        if len(found) > 1 << 16:
            found = [least_pivots(np.concatenate(found))]
    return least_pivots(np.concatenate(found)), hot


def least_pivots(pairs: np.ndarray) -> np.ndarray:
    """Each pair once, with its least pivot."""
    pairs = pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate(([True], (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)))] if len(pairs) else pairs


def rows_of(batch: pa.Table, names: tuple[str, ...] = ("h", "set", "n", "at")) -> list[np.ndarray]:
    """The columns of a batch, sorted by h and set, rows that repeat these (copies) once."""
    columns = [batch[k].to_numpy() for k in names]
    order = np.lexsort((columns[1], columns[0]))
    columns = [x[order] for x in columns]
    one = np.concatenate(([True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]))) if len(order) else order.astype(bool)
    return [x[one] for x in columns]


def candidates(firsts: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b, pivot), a < b, of sets that may be alike, and the rows of firsts (h, set, n, at) of the shingles that
    more than RUN sets hold, of which not all pairs are given; rows: about how many sets there are."""
    ranges, run = 1 << min(20, max(6, (rows // 500).bit_length())), RUN
    cut = firsts.withColumn("range", F.shiftrightunsigned("h", 64 - ranges.bit_length() + 1).cast("int"))

    def within(batch: pa.Table) -> pa.Table:
        h, sets, n, at = rows_of(batch)
        pairs, hot = paired(h, sets, n, at, run)
        k, none = int(hot.sum()), lambda m: np.zeros(m, np.int64)
        both = lambda x, y: pa.array(np.concatenate((x, y)))
        return pa.table({
            "a": both(pairs[:, 0], none(k)), "b": both(pairs[:, 1], none(k)), "pivot": both(pairs[:, 2], none(k)), "h": both(none(len(pairs)), h[hot]), "set": both(none(len(pairs)), sets[hot]),
            "n": both(none(len(pairs)), n[hot].astype(np.int64)), "at": both(none(len(pairs)), at[hot].astype(np.int64)), "hot": both(none(len(pairs)), none(k) + 1),
        })

    found = checkpointed(cut.groupBy("range").applyInArrow(within, "a long, b long, pivot long, h long, set long, n long, at long, hot long"))
    return once(found.where("hot = 0")), found.where("hot = 1").select("h", "set", "n", "at")


def once(pairs: DataFrame) -> DataFrame:
    """Each pair (a, b) once, with its least pivot."""
    return pairs.groupBy("a", "b").agg(F.min("pivot").alias("pivot"))


def joined_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (set, root), the groups of sets that a link (a, b) joins under one root."""
    of = lambda k: groups.select(F.col("set").alias(k), F.col("root").alias(f"root_{k}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.greatest("root_a", "root_b").alias("a"), F.least("root_a", "root_b").alias("b"))
    roots = components(edges).withColumnRenamed("root", "least")
    return checkpointed(groups.join(roots, F.col("root") == F.col("node"), "left").select("set", F.coalesce("least", "root").alias("root")))


def grouped(docs: DataFrame, marked: DataFrame, groups: DataFrame) -> DataFrame:
    """set, root: groups (set, root) as given, joined where sets of a likeness of 0.8 or more link them. docs (text),
    marked: described(text) of its rows as columns, with t, xxhash64 of the text."""
    count = marked.where("some is not null").select(F.explode("some").alias("h"), "set").distinct().groupBy("h").count().where("count >= 4")
    last = np.array([r["h"] for r in reversed(count.orderBy(F.desc("count"), "h").limit(LAST).collect())], np.int64).view(np.uint64)
    firsts = docs.select(first_shingles(F.col("text"), last).alias("f")).select("f.*").groupBy("set").agg(F.first("n").alias("n"), F.first("first").alias("first"))  # copies once
    firsts = firsts.select("set", "n", F.posexplode("first").alias("at", "h"))
    sets = checkpointed(marked.groupBy("set").agg(F.first("n").alias("n"), F.first("odd").alias("odd"), F.min("t").alias("t")))
    pairs, hot = candidates(firsts, sets.count())
    groups = joined_groups(groups, verified(docs, sets, groups, pairs))
    if hot.isEmpty():
        return groups
    for _ in range(ROUNDS):  # representatives of the groups that share a shingle, each with the least one
        named = hot.join(groups, "set").groupBy("h", "root").agg(F.min(F.struct("set", "n")).alias("x"))
        least = named.groupBy("h").agg(F.min("x").alias("y"), F.count("*").alias("k")).where("k > 1")
        pairs = named.join(least, "h").select(F.col("x.set").alias("b"), F.col("y.set").alias("a"), F.col("x.n").alias("n"), F.col("y.n").alias("m"))
        pairs = pairs.where((F.col("a") != F.col("b")) & (9 * F.least("n", "m") >= 4 * (F.col("n") + F.col("m"))))
        groups = joined_groups(groups, verified(docs, sets, groups, once(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("a").alias("pivot")))))
    return joined_groups(groups, verified(docs, sets, groups, across(hot, groups, sets)))


def folded(odd: pa.ChunkedArray) -> np.ndarray:
    """Parities of each set folded to PARITIES buckets, a row of longs each."""
    width = PARITIES // 64
    return np.stack([np.bitwise_xor.reduce(x.values.to_numpy().reshape(-1, width), axis=0) for x in odd.combine_chunks()])


def dealt(hot: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of hot (h, set, n, at) whose shingle has sets of several groups, with root and the task (kind, i, j) that
    each goes to. The largest group of a shingle is cut into c blocks, its other sets, the outsiders, into b. Kind 0: a
    block of the largest group with one of outsiders; kind 1: two blocks of outsiders. With few outsiders, each row of
    the largest group goes once, however large it is; they go to each of its blocks."""
    rows = hot.join(groups, "set")
    sizes = rows.groupBy("h", "root").agg(F.count("*").alias("k")).groupBy("h")
    many = sizes.agg(F.count("*").alias("roots"), F.max(F.struct("k", "root")).alias("big"), F.sum("k").alias("all")).where("roots > 1")
    blocks = lambda k: F.ceil(k / PART).cast("int")
    cuts = many.select("h", F.col("big.root").alias("big"), blocks(F.col("big.k")).alias("c"), blocks(F.col("all") - F.col("big.k")).alias("b"))
    out = F.col("root") != F.col("big")
    placed = rows.join(cuts, "h").withColumn("out", out).withColumn("k", F.pmod("set", F.when(out, F.col("b")).otherwise(F.col("c"))).cast("int"))
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    every = lambda n, to: F.transform(F.sequence(F.lit(0), F.col(n) - 1), to)
    k = F.col("k")
    inside = every("b", lambda o: task(0, k, o))
    outside = F.concat(every("c", lambda o: task(0, o, k)), every("b", lambda o: task(1, F.least(k, o), F.greatest(k, o))))
    return placed.withColumn("task", F.explode(F.when(F.col("out"), outside).otherwise(inside))).select("h", "set", "n", "at", "root", "out", "k", "task.*")


def across(hot: DataFrame, groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, pivot) of sets of different groups that share a shingle of hot and may be alike by places and
    parities; a task for each pair of blocks of one shingle."""
    spread = dealt(hot, groups).join(sets.select("set", "odd"), "set")

    def blocks(batch: pa.Table) -> pa.Table:
        numbered = batch.append_column("row", pa.array(np.arange(batch.num_rows)))
        h, ids, n, at, root, out, k, row = rows_of(numbered, ("h", "set", "n", "at", "root", "out", "k", "row"))
        kind, i, j = (batch[c][0].as_py() for c in ("kind", "i", "j"))
        apart = [out] if kind == 0 else [root] if i == j else [root, k]
        pairs, _ = paired(h, ids, n, at, apart=apart, odd=folded(batch["odd"])[row])
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "pivot": pa.array(pairs[:, 2])})

    return once(spread.groupBy("h", "kind", "i", "j").applyInArrow(blocks, "a long, b long, pivot long"))


def verified(docs: DataFrame, sets: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are alike, of those (a, b, pivot) that join different groups."""
    about = sets.join(groups, "set")
    side = lambda k: about.select(F.col("set").alias(k), *[F.col(x).alias(f"{x}_{k}") for x in ("n", "odd", "t", "root")])
    left = pairs.join(side("a"), "a").join(side("b"), "b").where("root_a <> root_b").where(9 * differing(F.col("odd_a"), F.col("odd_b")) <= F.col("n_a") + F.col("n_b"))
    left = checkpointed(left.select("a", "b", "pivot", "n_a", "n_b", "t_a", "t_b"))
    needed = small_or_not(left.select(F.col("t_a").alias("t")).union(left.select("t_b")).distinct())

    @text_udf("array<long>")
    def shingle_hashes(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    read = docs.select("text", F.xxhash64("text").alias("t")).join(needed, "t", "left_semi").dropDuplicates(["t"])
    read = checkpointed(read.select("t", shingle_hashes(F.col("text")).alias("s")))
    return compared(left, read)


def compared(left: DataFrame, read: DataFrame) -> DataFrame:
    """The pairs (a, b) of left (a, b, pivot, n_a, n_b, t_a, t_b) that are alike; read: t and its shingles s. Pairs of one
    pivot, as those of a group of near copies mostly are, are compared together, so that a set of many pairs is sent once;
    a pivot of more than BLOCK shingles is cut into parts, and sets are sent to the pairs of parts that need them."""
    ends = left.select("pivot", F.explode(F.array(*[F.struct(F.col(f"t_{k}").alias("t"), F.col(f"n_{k}").alias("n")) for k in "ab"])).alias("x")).select("pivot", "x.*")
    parts = ends.groupBy("pivot", "t").agg(F.first("n").alias("n")).groupBy("pivot").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("c"))
    cut = left.join(parts, "pivot").withColumn("k", F.pmod("t_a", "c")).withColumn("o", F.pmod("t_b", "c"))
    cut = checkpointed(cut.select("pivot", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "a", "b", "t_a", "t_b"))
    block = ["pivot", "i", "j"]
    sent = cut.select(*block, F.explode(F.array("t_a", "t_b")).alias("t")).distinct().join(read, "t")

    def check(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        held = {t: s.values.to_numpy().view(np.uint64) for t, s in zip(sets["t"].to_pylist(), sets["s"].combine_chunks())}
        good = []
        for x, y in zip(pairs["t_a"].to_pylist(), pairs["t_b"].to_pylist()):
            x, y = held[x], held[y]
            good.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
        return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = cut.select(*[F.col(k).alias(f"p_{k}") for k in block], "a", "b", "t_a", "t_b")
    return pairs.groupBy(*[f"p_{k}" for k in block]).cogroup(sent.groupBy(*block)).applyInArrow(check, "a long, b long")
