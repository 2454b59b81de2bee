"""Retrieval: dense and lexical search, fusion, ranking, selection.

Documents are chunked; vec_id of embeddings is taken as the doc_id whose first chunk it embeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.frames import checkpointed
from corpusmill.plans.registry import query
from corpusmill.sources import termindex, vectorindex
from corpusmill.sources.stored import derived
from corpusmill.sources.tables import load
from corpusmill.sources.vectorindex import matrix, unit

from .text import chunks

#: The standing question of the queries: its phrase and terms, and the vector of its embedding.
PHRASE, TERMS, PROBE = "the in", ("the", "in", "and"), 0
HALF_LIFE = 90.0
#: Vectors of one block of a block-wise search.
BLOCK = 1024

DENSE = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
dense AS (SELECT vec_id, label, 1 - list_cosine_similarity(v, (SELECT v FROM e WHERE vec_id = 0)) AS distance FROM e)
"""
CHUNKS = DENSE + """,
chunks AS (SELECT doc_id, source, CAST(i AS INTEGER) AS chunk_index, lower(substr(text, 1 + 520 * i, 600)) AS norm FROM (
  SELECT doc_id, source, text, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - 600) / 520.0) AS BIGINT)))) AS i FROM documents)),
matched AS (SELECT *, contains(norm, 'the in') AS phrase, contains(norm, 'the')::INT + contains(norm, 'in')::INT + contains(norm, 'and')::INT AS hits FROM chunks),
lexical AS (SELECT * FROM matched WHERE hits = 3),
near AS (SELECT vec_id FROM dense ORDER BY round(distance, 9), vec_id LIMIT 400),
candidates AS (SELECT m.* FROM matched m WHERE hits = 3 OR (chunk_index = 0 AND doc_id IN (SELECT vec_id FROM near))),
fused AS (
  SELECT c.doc_id, c.source, c.chunk_index, CASE WHEN phrase THEN 2 WHEN hits = 3 THEN 1 ELSE 0 END AS tier,
    least(0.999, round(1 - distance + CASE WHEN phrase THEN 0.25 WHEN hits = 3 THEN 0.15 ELSE 0.05 * hits / 3.0 END, 4)) AS score
  FROM candidates c JOIN dense d ON d.vec_id = c.doc_id)
"""


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of doubles; null if one is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distances(vectors: DataFrame, probe: int) -> DataFrame:
    """vec_id, label, distance of every vector to one of them; only that one vector is broadcast."""
    v = F.col("embedding").cast("array<double>")
    wanted = vectors.where(F.col("vec_id") == probe).select(v.alias("q")).limit(1)
    return vectors.select("vec_id", "label", v.alias("v")).crossJoin(F.broadcast(wanted)).select("vec_id", "label", (1 - cosine(F.col("v"), F.col("q"))).alias("distance"))


def nearest(probes: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """probe, vec_id, distance, rn: the k nearest other vectors of each probe, by distance to nine places, then vec_id.

    A stated set of probes meets all vectors in blocks: both sides are packed into matrices, each pair of blocks is
    one product that keeps k rows for each probe, and what the blocks keep is merged by a ranked window."""

    def packed(rows: DataFrame, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-rows.count() // BLOCK))))
        return rows.groupBy(block.alias(f"{name}_block")).agg(F.collect_list("vec_id").alias(f"{name}_ids"), F.collect_list("embedding").alias(name))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, v = (unit(matrix(batch.column(n)[i].values)) for n in ("p", "v"))
                ids, own = (batch.column(n)[i].values.to_numpy() for n in ("v_ids", "p_ids"))
                far = np.round(1 - p @ v.T, 9)
                far[own[:, None] == ids[None, :]] = np.inf
                order = np.lexsort((np.broadcast_to(ids, far.shape), far), axis=1)[:, :k]
                kept = np.take_along_axis(far, order, axis=1)
                ok = np.isfinite(kept)
                yield pa.RecordBatch.from_pydict({"probe": np.broadcast_to(own[:, None], order.shape)[ok], "vec_id": ids[order][ok], "distance": kept[ok]})

    pairs = packed(vectors, "v").crossJoin(packed(probes, "p"))
    found = pairs.select("p_ids", "p", "v_ids", "v").mapInArrow(search, "probe long, vec_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("distance", "vec_id"))
    return found.withColumn("rn", rank).where(F.col("rn") <= k)


def term_index(spark: SparkSession, d: str) -> termindex.TermIndex:
    """The index of the documents' chunks, lower case; written when a table is first searched."""
    keys = ["doc_id", "chunk_index"]

    def build(path: str) -> None:
        docs = load(spark, d, "documents").select("doc_id", "source", "text")
        termindex.write_index(chunks(docs).withColumn("content", F.lower("content")), keys, "content", path)

    return termindex.TermIndex(spark, derived(spark, "terms", f"{d}/documents.parquet", build), keys)


def vector_index(spark: SparkSession, d: str, where: Column | None = None) -> vectorindex.VectorIndex:
    """The index of the embeddings; where: which of them count."""
    build = lambda path: vectorindex.write_index(load(spark, d, "embeddings"), path)
    return vectorindex.VectorIndex(spark, derived(spark, "vectors", f"{d}/embeddings.parquet", build), where)


def counted_hits(norm: Column, terms: tuple[str, ...] = TERMS) -> Column:
    """How many of the terms a normalised chunk holds."""
    return sum((F.contains(norm, F.lit(t)).cast("int") for t in terms), F.lit(0))


def found_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lexical hits and the first chunks of the nearest 400 documents, once each, with distance (null for documents without
    a vector). Lexical hits come from the term index, which holds what the others need of their texts too."""
    far = distances(load(spark, d, "embeddings"), PROBE).select(F.col("vec_id").alias("doc_id"), "distance")
    near = far.orderBy(F.round("distance", 9), "doc_id").limit(400).select("doc_id")
    index = term_index(spark, d)
    first = index.chunks.where("chunk_index = 0").join(F.broadcast(near), "doc_id", "left_semi")
    columns = ("doc_id", "source", "chunk_index", "norm")
    hits = counted_hits(F.col("norm"))
    rows = index.search(list(TERMS)).select(*columns, F.lit(len(TERMS)).alias("hits")).unionByName(first.select(*columns, hits.alias("hits")).where(F.col("hits") < len(TERMS)))
    return rows.select("doc_id", "source", "chunk_index", F.contains("norm", F.lit(PHRASE)).alias("phrase"), "hits").join(far, "doc_id", "left")


def tier_and_bonus(phrase: Column, hits: Column, n_terms: int) -> tuple[Column, Column]:
    """The tier of a match and what it adds to the score: the phrase; all of two terms or more; a share of the terms, which
    a single term, found or not, stays with."""
    full = (hits == n_terms) & F.lit(n_terms >= 2)
    share = 0.05 * hits / float(n_terms) if n_terms else F.lit(0.0)
    return F.when(phrase, 2).when(full, 1).otherwise(0), F.when(phrase, 0.25).when(full, 0.15).otherwise(share)


def fused(spark: SparkSession, d: str) -> DataFrame:
    """The chunks found, with tier and fused score; those without a distance drop out (undistanced_hits counts them)."""
    rows = found_chunks(spark, d).where("distance is not null")
    tier, bonus = tier_and_bonus(F.col("phrase"), F.col("hits"), len(TERMS))
    return rows.select("doc_id", "source", "chunk_index", tier.alias("tier"), F.least(F.lit(0.999), F.round(1 - F.col("distance") + bonus, 4)).alias("score"))


@query(CHUNKS + "SELECT count(*) AS candidates, count(*) FILTER (d.vec_id IS NULL) AS skipped FROM candidates c LEFT JOIN dense d ON d.vec_id = c.doc_id")
def undistanced_hits(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates there are, and how many of them are passed over for want of a distance."""
    return found_chunks(spark, d).agg(F.count("*").alias("candidates"), F.count_if(F.col("distance").isNull()).alias("skipped"))


@query(DENSE + "SELECT vec_id, round(distance, 6) AS distance FROM dense WHERE label <> 3 ORDER BY round(distance, 9), vec_id LIMIT 25")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = distances(load(spark, d, "embeddings").where("label <> 3 or vec_id = 0"), PROBE).where("label <> 3")
    return rows.orderBy(F.round("distance", 9), "vec_id").limit(25).select("vec_id", F.round("distance", 6).alias("distance"))


@query(CHUNKS + "SELECT doc_id, chunk_index, phrase FROM lexical")
def lexical_and(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that hold all terms, from the term index; the phrase is looked for in those alone."""
    found = term_index(spark, d).search(list(TERMS))
    return found.select("doc_id", "chunk_index", F.contains("norm", F.lit(PHRASE)).alias("phrase"))


@query(CHUNKS + """, capped AS (SELECT * FROM lexical WHERE doc_id % 2 = 0 ORDER BY doc_id, chunk_index LIMIT 2000)
SELECT doc_id, chunk_index, phrase, (SELECT count(*) FROM capped) AS lex_hits FROM capped
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY NOT phrase, chunk_index) = 1
""")
def lexical_per_report(spark: SparkSession, d: str) -> DataFrame:
    """Of the chunks with all terms that a filter accepts, the 2000 of least key, so that a search repeats itself; of these
    one for each document, those with the phrase first. lex_hits tells whether the cap was reached."""
    index, phrase = term_index(spark, d), F.contains("norm", F.lit(PHRASE))
    hits = checkpointed(index.search(list(TERMS), where=F.col("doc_id") % 2 == 0, cap=2000).select("doc_id", "chunk_index", phrase.alias("phrase")))
    total = hits.agg(F.count("*").alias("lex_hits"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(~F.col("phrase"), "chunk_index"))
    return hits.withColumn("n", best).where("n = 1").drop("n").crossJoin(F.broadcast(total))


@query(CHUNKS + "SELECT doc_id, chunk_index, tier, score FROM fused ORDER BY tier DESC, score DESC, doc_id, chunk_index LIMIT 50")
def hybrid_fused(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d).orderBy(F.desc("tier"), F.desc("score"), "doc_id", "chunk_index").limit(50).select("doc_id", "chunk_index", "tier", "score")


RANKED = CHUNKS + """, reports AS (
  SELECT doc_id, max(tier) AS tier, arg_max(score, struct_pack(a := tier, b := score)) AS score, count(*) AS match_count, arg_max(chunk_index, struct_pack(a := tier, b := score, c := -chunk_index)) AS best_chunk,
    list_sort(list(struct_pack(a := -tier, b := -score, c := chunk_index))) AS sorted FROM fused GROUP BY doc_id),
dated AS (SELECT r.*, CAST(floor(score / 0.05 + 1e-9) AS BIGINT) AS band, CAST(o.o_orderdate AS DATE) AS report_date FROM reports r LEFT JOIN orders o ON o.o_orderkey = r.doc_id)
"""


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Chunks grouped to documents: best tier and score, number of matches, best chunk."""
    return fused(spark, d).groupBy("doc_id").agg(
        F.max("tier").alias("tier"), F.max_by("score", F.struct("tier", "score")).alias("score"), F.count("*").alias("match_count"),
        F.max_by("chunk_index", F.struct("tier", "score", -F.col("chunk_index"))).alias("best_chunk"),
    )


def dated_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports with their band and date, the date of the order of the same number, null for none."""
    dates = load(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("report_date"))
    return reports(spark, d).withColumn("band", F.floor(F.col("score") / 0.05 + 1e-9)).join(dates, "doc_id", "left")


BEST = "SELECT doc_id, tier, band, report_date, score, match_count, best_chunk FROM dated "


@query(RANKED + BEST + "ORDER BY tier DESC, band DESC, report_date DESC NULLS LAST, score DESC, doc_id DESC LIMIT 30")
def rank_reports_rel(spark: SparkSession, d: str) -> DataFrame:
    """By relevance: tier, then band of the score, the newest first inside a band."""
    order = (F.desc("tier"), F.desc("band"), F.desc_nulls_last("report_date"), F.desc("score"), F.desc("doc_id"))
    return dated_reports(spark, d).orderBy(*order).limit(30).select("doc_id", "tier", "band", "report_date", "score", "match_count", "best_chunk")


@query(RANKED + "SELECT doc_id, report_date, score FROM dated ORDER BY report_date DESC NULLS LAST, score DESC, doc_id DESC LIMIT 30")
def rank_reports_date(spark: SparkSession, d: str) -> DataFrame:
    """Newest first, undated last."""
    rows = dated_reports(spark, d).orderBy(F.desc_nulls_last("report_date"), F.desc("score"), F.desc("doc_id"))
    return rows.limit(30).select("doc_id", "report_date", "score")


@query(RANKED + "SELECT doc_id, report_date, score FROM dated ORDER BY report_date ASC NULLS LAST, score DESC, doc_id LIMIT 30")
def rank_reports_oldest(spark: SparkSession, d: str) -> DataFrame:
    """Oldest first, undated last."""
    rows = dated_reports(spark, d).orderBy(F.asc_nulls_last("report_date"), F.desc("score"), "doc_id")
    return rows.limit(30).select("doc_id", "report_date", "score")


@query(RANKED + """SELECT doc_id, len(sorted) AS n, array_to_string(list_transform(sorted[1:3], lambda x: (-x.a)::INT || ':' || x.c), ' ') AS passages FROM dated""")
def report_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every document's matches, best first, as its list of passages; the three best are shown. A document has as many
    as chunks."""
    passage = F.struct((-F.col("tier")).alias("a"), (-F.col("score")).alias("b"), F.col("chunk_index").alias("c"))
    listed = fused(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(passage)).alias("sorted"))
    shown = F.transform(F.slice("sorted", 1, 3), lambda x: F.concat_ws(":", (-x.a).cast("string"), x.c.cast("string")))
    return listed.select("doc_id", F.size("sorted").cast("long").alias("n"), F.array_join(shown, " ").alias("passages"))


@query(RANKED + """, placed AS (SELECT doc_id, tier, score, row_number() OVER (ORDER BY tier DESC, score DESC, doc_id) AS place FROM reports),
again AS (SELECT *, CASE WHEN place <= 20 THEN (doc_id * 37 % 101) / 101.0 END AS reranked FROM placed WHERE place <= 60)
SELECT doc_id, CAST(row_number() OVER (ORDER BY place > 20, CASE WHEN place <= 20 THEN -tier END, CASE WHEN place <= 20 THEN -reranked END, place) AS INTEGER) AS place FROM again
""")
def rerank_head(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty in a second scorer's order within their tiers, the others as they were."""
    one = Window.partitionBy(F.lit(0))  # sixty rows
    top = reports(spark, d).orderBy(F.desc("tier"), F.desc("score"), "doc_id").limit(60)
    placed = top.withColumn("place", F.row_number().over(one.orderBy(F.desc("tier"), F.desc("score"), "doc_id")))
    head = F.col("place") <= 20
    again = F.when(head, (F.col("doc_id") * 37 % 101) / 101.0)
    order = one.orderBy((~head), F.when(head, -F.col("tier")), F.when(head, -again), "place")
    return placed.select("doc_id", F.row_number().over(order).alias("place"))


#: Vectors of one report, which follow each other; how far a similar passage may be here, where vectors are drawn by chance.
REPORT, SIMILAR = 40, 0.75


def spaced(rows: DataFrame, group: str, order: str, most: int = 12) -> DataFrame:
    """At most so many rows of each group, evenly spaced over all of it: of n rows those numbered floor(g n / m) for g
    below m, the lesser of n and most."""
    of = Window.partitionBy(group)
    placed = rows.withColumn("_rn", F.row_number().over(of.orderBy(order)) - 1).withColumn("_n", F.count("*").over(of)).withColumn("_m", F.least("_n", F.lit(most)))
    g = F.expr("(_rn * _m + _n - 1) div _n")
    return placed.withColumn("_g", g).where("_g < _m and (_g * _n) div _m = _rn").drop("_rn", "_n", "_m", "_g")


def similar_reports(index: vectorindex.VectorIndex, vectors: DataFrame, report: Column, wanted: Column, *, most: int = 12, per_probe: int = 20, max_dist: float = 0.45, min_probes: int = 2, limit: int = 6) -> DataFrame:
    """own, report, matched_probes, score, best_dist, place: what is most like each wanted report. Spaced passages of it
    each find their nearest ones in other reports; a report counts once for each passage, by its nearest, so that one
    common paragraph makes none similar, and is ranked by the sum of likenesses."""
    rows = vectors.where("embedding is not null").select("vec_id", "embedding", report.cast("long").alias("own")).where(wanted)
    probes = spaced(rows, "own", "vec_id", most).withColumnRenamed("vec_id", "probe")
    near = index.nearest(probes, per_probe, within=max_dist, apart=report)
    hits = near.withColumnRenamed("vec_id", "hit").join(probes.select("probe", "own"), "probe").withColumn("vec_id", F.col("hit"))
    best = hits.groupBy("probe", "own", report.alias("report")).agg(F.min("distance").alias("distance"))
    found = best.groupBy("own", "report").agg(F.count("*").alias("matched_probes"), F.round(F.sum(1 - F.col("distance")), 6).alias("score"), F.min("distance").alias("best_dist"))
    place = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "best_dist", "report"))
    return found.where(F.col("matched_probes") >= min_probes).withColumn("place", place).where(F.col("place") <= limit)


@query(f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, vec_id // {REPORT} AS report FROM embeddings),
numbered AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY vec_id) - 1 AS rn, count(*) OVER (PARTITION BY report) AS n FROM e WHERE report % 5 = 0),
probes AS (SELECT vec_id AS probe, v AS pv, report AS own FROM numbered WHERE rn IN (SELECT (g * n) // least(n, 12) FROM range(12) t(g) WHERE g < least(n, 12))),
near AS (SELECT * FROM (SELECT probe, own, report, round(1 - list_cosine_similarity(pv, v), 9) AS distance, row_number() OVER (PARTITION BY probe ORDER BY round(1 - list_cosine_similarity(pv, v), 9), vec_id) AS rn FROM probes, e WHERE report <> own) WHERE rn <= 20 AND distance <= {SIMILAR}),
best AS (SELECT probe, own, report, min(distance) AS distance FROM near GROUP BY 1, 2, 3),
found AS (SELECT own, report, count(*) AS matched_probes, round(sum(1 - distance), 6) AS score, min(distance) AS best_dist FROM best GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT own, report, matched_probes, score, round(best_dist, 6) AS best_dist, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, best_dist, report) AS INTEGER) AS place FROM found
QUALIFY place <= 6
""")
def similar_docs(spark: SparkSession, d: str) -> DataFrame:
    """The reports most like each fifth one, by twelve passages of it and twenty neighbours of each; exact."""
    report = F.expr(f"vec_id div {REPORT}")
    found = similar_reports(vector_index(spark, d), load(spark, d, "embeddings"), report, F.col("own") % 5 == 0, max_dist=SIMILAR)
    return found.select("own", "report", "matched_probes", "score", F.round("best_dist", 6).alias("best_dist"), "place")


@query("""
SELECT label, count(*) AS n, round(avg(distance), 6) AS mean FROM (
  SELECT e.label, 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS distance FROM embeddings e) WHERE distance <= 1.0 GROUP BY label
""")
def facets_of_hits(spark: SparkSession, d: str) -> DataFrame:
    return distances(load(spark, d, "embeddings"), PROBE).where("distance <= 1.0").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("mean"))


@query(r"""
SELECT conv_id, turn, CASE WHEN regexp_matches(t, 'password|kill') THEN 'safety' WHEN regexp_matches(t, '(^|[^\p{L}\p{M}\p{N}_])(buy|sell|order)($|[^\p{L}\p{M}\p{N}_])') THEN 'trade' WHEN regexp_matches(t, 'today|latest|now') THEN 'time' WHEN regexp_matches(t, '^(what|how|the)') THEN 'overview' ELSE 'general' END AS route
FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user')
""")
def rule_router(spark: SparkSession, d: str) -> DataFrame:
    """The route of each question, by the first rule that fits. A trading word counts as a whole word only, and letters of
    any script, marks and digits belong to words."""
    t, whole = F.lower("text"), r"(^|[^\p{L}\p{M}\p{N}_])(buy|sell|order)(\z|[^\p{L}\p{M}\p{N}_])"
    route = F.when(t.rlike("password|kill"), "safety").when(t.rlike(whole), "trade").when(t.rlike("today|latest|now"), "time").when(t.rlike("^(what|how|the)"), "overview")
    return load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", route.otherwise("general").alias("route"))
