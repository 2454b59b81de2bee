r"""Document fingerprints (operator 3): a Merkle tree over paragraphs and sections.

A text is cut into paragraphs: its lines, and within a line its sentences, none longer than SPAN code points, so that
a text of one line has branches too. Each paragraph has a hash, its leaf; SECTION leaves in a row form a section, whose
hash covers them; the root covers the sections' hashes. Equal texts have equal roots. Where roots differ, the first
section that differs and in it the first leaf that does, and the same from the end, leave the paragraphs that an edit
replaced, removed or added. The likeness of two trees is the Dice coefficient of their sets of leaves.

Only DataFrame functions are used. Nulls count as empty texts, whose tree has no paragraph; two of them are alike to
1. Long texts are cut whole, in time linear in them. Repeated rows get a row each. Rows with a null doc_id come last in
the order of ids; rows of equal doc_id are ordered by a digest of their text. The next document of the last one is the
first. Columns of docs beyond those named are not read, and an empty table gives no rows.

Each text is shuffled once: the order of (doc_id, digest) is cut into ranges at rows of a sample, so that rows without
an id or with one id are spread as well, and the first row of a range travels to the range before it too, where it is
the next document of the last row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, uniform

#: Paragraph hashes under one section.
SECTION = 16
#: Code points of a paragraph at most.
SPAN = 160
#: The shortest run that ends after a line end, after a sentence mark and its space, or with the text; else SPAN.
PARAGRAPH = rf"[\s\S]{{1,{SPAN}}}?(?:(?<=\n)|(?<=[.!?] )|\z)|[\s\S]{{{SPAN}}}"
#: Rows of a range of ids, about; the most ranges, beyond which ranges grow and a task orders them by spilling; and the
#: rows read to find where a range begins.
ROWS, RANGES, SAMPLED = 250, 1 << 17, 8


def tree(text: Column) -> Column:
    """struct<root string, sections array<string>, leaves array<long>> of a text that is not null."""
    cut = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p))

    def grow(leaves: Column) -> Column:
        sections = F.transform(
            F.sequence(F.lit(0), F.greatest(F.ceil(F.size(leaves) / SECTION) - 1, F.lit(0))),
            lambda i: F.md5(F.array_join(F.transform(F.slice(leaves, (i * SECTION + 1).cast("int"), SECTION), lambda h: F.hex(h)), ",").cast("binary")),
        )
        return F.struct(sections.alias("sections"), leaves.alias("leaves"))

    # transform over one element names a value, so that it is computed once
    grown = F.transform(F.array(cut), grow)[0]
    return F.transform(F.array(grown), lambda t: F.struct(F.md5(F.array_join(t["sections"], "").cast("binary")).alias("root"), t["sections"].alias("sections"), t["leaves"].alias("leaves")))[0]


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct leaves that two trees have in common, 0 to 1; 1 if neither has any."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def alike_for(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common at their beginning."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))  # past the shorter one's end there is null, which no hash equals
    return F.transform(F.array(F.array_position(same, False)), lambda at: F.when(at > 0, at - 1).otherwise(F.size(same).cast("long")))[0]


def edit(old: Column, new: Column) -> Column:
    """struct<section, paragraph, removed, added> of two trees (structs of sections and leaves): the first section that
    differs and the first paragraph, both from 1 and 0 if none does, and how many paragraphs from there on the old text
    had that the new one has replaced by how many. Equal sections are skipped by their hashes; from the end, leaves are
    compared, since sections no longer stand under each other after an insertion."""
    a, b = old["leaves"], new["leaves"]
    sections = alike_for(old["sections"], new["sections"])
    part = lambda x, at: F.slice(x, (at * SECTION + 1).cast("int"), SECTION)
    rest = lambda x, at: F.slice(x, (at + 1).cast("int"), F.greatest(F.size(x) - at, F.lit(0)).cast("int"))

    def of(s: Column) -> Column:
        start = F.least(s * SECTION + alike_for(part(a, s), part(b, s)), F.size(a).cast("long"), F.size(b).cast("long"))

        def ends(at: Column) -> Column:
            tail = F.transform(F.array(alike_for(F.reverse(rest(a, at)), F.reverse(rest(b, at)))), lambda t: F.struct((F.size(a) - at - t).alias("r"), (F.size(b) - at - t).alias("d")))[0]
            return F.transform(F.array(tail), lambda t: F.struct(
                F.when((t["r"] == 0) & (t["d"] == 0), 0).otherwise(s + 1).cast("long").alias("section"),
                F.when((t["r"] == 0) & (t["d"] == 0), 0).otherwise(at + 1).cast("long").alias("paragraph"), t["r"].cast("long").alias("removed"), t["d"].cast("long").alias("added"),
            ))[0]

        return F.transform(F.array(start), ends)[0]

    return F.transform(F.array(sections), of)[0]


def with_next(docs: DataFrame, payload: list[str], rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text, payload columns) with next: a struct of the payload columns of the next document by doc_id."""
    key = F.struct(F.col("doc_id").isNull().alias("lone"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    keys = docs.select(key.alias("k"))
    n, least = keys.agg(F.count("*"), F.min("k")).first()
    count = max(1, min(RANGES, -(-n // rows)))
    bounds = []
    if count > 1:
        share = min(1.0, SAMPLED * count / n)
        picked = keys.select("k.*").where(uniform(F.col("id"), F.col("h")) < share).toPandas()
        picked = picked.drop_duplicates().sort_values(["lone", "id", "h"]).iloc[:: max(1, len(picked) // count)]
        bounds = sorted({tuple(least), *((bool(r[0]), int(r[1]), int(r[2])) for r in picked.itertuples(index=False))})
    load, inside = F.struct(*payload), docs.withColumn("_key", key)
    if len(bounds) > 1:
        # bucket: the last bound that is not above the key, by binary search in constant arrays, one for each part of it
        column = lambda i: F.split(F.lit(",".join(str(int(b[i])) for b in bounds)), ",").cast("array<bigint>")
        lone, ident, digest = column(0), column(1), column(2)
        last = len(bounds) - 1
        mine = (F.col("_key.lone").cast("long"), F.col("_key.id"), F.col("_key.h"))

        def at(k: Column) -> tuple[Column, Column, Column]:
            return F.element_at(lone, k + 1), F.element_at(ident, k + 1), F.element_at(digest, k + 1)

        def not_above(k: Column) -> Column:
            a, b, c = at(k)
            return (a < mine[0]) | ((a == mine[0]) & ((b < mine[1]) | ((b == mine[1]) & (c <= mine[2]))))

        steps = [1 << k for k in reversed(range(last.bit_length()))]
        probe = lambda lo, step: F.when((lo + step <= last) & not_above(F.least(lo + step, F.lit(last))), lo + step).otherwise(lo)
        inside = inside.withColumn("_bucket", F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), probe))
        a, b, c = at(F.col("_bucket"))
        first = (a == mine[0]) & (b == mine[1]) & (c == mine[2])
        here = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("copy"))
        before = F.struct(F.when(F.col("_bucket") == 0, F.lit(last)).otherwise(F.col("_bucket") - 1).alias("b"), F.lit(1).alias("copy"))
        inside = inside.select("*", F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here))).alias("_place"))
        inside = inside.select("*", F.col("_place.b").alias("_b"), F.col("_place.copy").alias("_copy")).drop("_place", "_bucket")
    else:
        inside = inside.select("*", F.lit(0).alias("_b"), F.lit(0).alias("_copy"))
    order = Window.partitionBy("_b").orderBy("_copy", "_key")
    paired = inside.withColumn("next", F.lead(load).over(order))
    if len(bounds) <= 1:
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        paired = paired.withColumn("next", F.coalesce("next", F.first(load).over(whole)))
    return paired.where("_copy = 0").drop("_b", "_copy", "_key")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text: its last half replaced by as much of the next one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    trees = with_next(docs.withColumn("tree", tree(F.col("text"))), ["text", "tree.leaves"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    out = trees.withColumn("edited", edited).withColumn("edited_tree", tree(F.col("edited")))
    return out.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("tree.root").alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        likeness(F.col("tree.leaves"), F.col("edited_tree.leaves")).alias("near_edited"),
        likeness(F.col("tree.leaves"), F.col("next.leaves")).alias("near_next"),
        edit(F.col("tree"), F.col("edited_tree")).alias("edit"),
    )
