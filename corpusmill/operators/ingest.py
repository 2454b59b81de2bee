"""From a document to rows: gates, page headers, blocks in order, quotes found again, takeaways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import textfns
from corpusmill.plans.registry import query
from corpusmill.sources.tables import load

#: A quote counts as found if it stands in the text once: not again from its second character on either.
QUOTES = r"""
WITH docs AS (SELECT doc_id, text, regexp_replace(lower(text), '\s+', '', 'g') AS flat, string_split(text, chr(10)) AS lines FROM documents),
asked AS (SELECT doc_id, text, flat, CAST(i AS INTEGER) AS i, CASE i % 3 WHEN 1 THEN lines[i] WHEN 2 THEN lower(lines[i]) ELSE lines[i] || ' and so on' END AS quote FROM (SELECT *, unnest(generate_series(1, len(lines))) AS i FROM docs)),
norm AS (SELECT *, regexp_replace(lower(quote), '\s+', '', 'g') AS q FROM asked),
tiers AS (SELECT *, CASE WHEN quote <> '' AND contains(text, quote) THEN CASE WHEN (contains(text, quote) AND NOT contains(substr(text, instr(text, quote) + 1), quote)) THEN 'exact' END WHEN length(q) < 12 THEN NULL WHEN (contains(flat, q) AND NOT contains(substr(flat, instr(flat, q) + 1), q)) THEN 'normalized'
  WHEN length(q) > 48 AND (contains(flat, q[1:48]) AND NOT contains(substr(flat, instr(flat, q[1:48]) + 1), q[1:48])) THEN 'prefix' WHEN length(q) > 32 AND (contains(flat, q[1:32]) AND NOT contains(substr(flat, instr(flat, q[1:32]) + 1), q[1:32])) THEN 'prefix' WHEN length(q) > 20 AND (contains(flat, q[1:20]) AND NOT contains(substr(flat, instr(flat, q[1:20]) + 1), q[1:20])) THEN 'prefix' END AS tier FROM norm)
"""


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text, quotes: every line of a document as a model would quote it: as it is, without capitals, or with a tail that
    is not there."""
    lines = F.split("text", "\n")
    said = F.transform(lines, lambda x, i: F.when(i % 3 == 0, x).when(i % 3 == 1, F.lower(x)).otherwise(F.concat(x, F.lit(" and so on"))))
    return load(spark, d, "documents").select("doc_id", "text", said.alias("quotes"))


def anchored(rows: DataFrame) -> DataFrame:
    """doc_id, i (from 1), quote, tier, start, stop of each quote; a document's text travels once for all of its quotes."""
    found = rows.select("doc_id", F.posexplode(F.arrays_zip("quotes", textfns.anchor_quotes("text", "quotes").alias("at"))).alias("i", "x"))
    return found.select("doc_id", (F.col("i") + 1).alias("i"), F.col("x.quotes").alias("quote"), "x.at.tier", "x.at.start", "x.at.stop")


@query(QUOTES + "SELECT doc_id, i, tier, CASE WHEN tier = 'exact' THEN CAST(instr(text, quote) - 1 AS INTEGER) END AS start FROM tiers")
def quote_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Where each quote stands in its text, and how it was found: as it is, in normal form, or by its beginning."""
    return anchored(quotes(spark, d)).select("doc_id", "i", "tier", F.when(F.col("tier") == "exact", F.col("start")).alias("start"))


@query(r"""
WITH whole AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
cut AS (SELECT doc_id, t, i, CASE WHEN length(t) <= 600 THEN t ELSE substr(t, 1 + 520 * i, 600) END AS c, CASE WHEN i > 0 THEN right(substr(t, 1 + 520 * (i - 1), 600), 80) ELSE '' END AS tail FROM (
  SELECT doc_id, t, unnest(generate_series(0, CASE WHEN length(t) <= 600 THEN 0 ELSE CAST(ceil(length(t) / 520.0) AS BIGINT) - 1 END)) AS i FROM whole WHERE t <> '' AND NOT regexp_matches(t, '\n\s*\n') AND NOT starts_with(t, '|'))),
flat AS (SELECT doc_id, i, regexp_replace(lower(t), '\s+', '', 'g') AS f, regexp_replace(lower(tail || c), '\s+', '', 'g') AS q FROM cut),
probes AS (SELECT *, CASE WHEN length(q) > 120 THEN substr(q, 81) ELSE q END AS rest, CASE WHEN length(q) > 120 THEN substr(q, 1 + (length(q) - 120) // 2, 120) ELSE '' END AS middle FROM flat)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CASE WHEN contains(f, rest) THEN 'rest' WHEN middle <> '' AND contains(f, middle) THEN 'middle' END AS how,
  CASE WHEN contains(f, rest) THEN instr(f, rest) - 1 WHEN middle <> '' AND contains(f, middle) THEN instr(f, middle) - 1 END AS at FROM probes
""")
def chunk_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Where each stored chunk stands in its text: without the overlap that cutting has put before it, else by its middle. A
    document's text and chunks travel together and are searched in one pass."""
    rows = load(spark, d, "documents").select("doc_id", "text", textfns.chunk_text("text").alias("chunks"))
    found = rows.select("doc_id", F.posexplode(textfns.anchor_chunks("text", "chunks")).alias("chunk_index", "x"))
    return found.select("doc_id", "chunk_index", "x.how", "x.at")


@query(QUOTES + "SELECT t.doc_id, md5(any_value(text)) AS sha, count(*) AS total, count(tier) AS anchored FROM tiers t GROUP BY t.doc_id")
def reanchor_counts(spark: SparkSession, d: str) -> DataFrame:
    """A document's quotes looked up again in its present text: its digest, how many there are and how many were found."""
    rows = quotes(spark, d)
    found = anchored(rows).groupBy("doc_id").agg(F.count("*").alias("total"), F.count("tier").alias("anchored"))
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("sha")).join(found, "doc_id").select("doc_id", "sha", "total", "anchored")


@query(QUOTES + r"""
, claims AS (SELECT doc_id, min(i) AS i, trim(q[1:30]) AS claim FROM tiers WHERE length(q) >= 5 GROUP BY doc_id, trim(q[1:30])), five AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM claims)
SELECT d.doc_id, count(f.claim) AS takeaways, count(t.tier) AS anchored, CASE WHEN count(f.claim) = 0 THEN 'rejected' WHEN count(t.tier) < count(f.claim) THEN 'partial' ELSE 'valid' END AS status
FROM docs d LEFT JOIN (SELECT * FROM five WHERE n <= 5) f ON f.doc_id = d.doc_id LEFT JOIN tiers t ON t.doc_id = f.doc_id AND t.i = f.i WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY d.doc_id
""")
def takeaway_rows(spark: SparkSession, d: str) -> DataFrame:
    """Takeaways of documents that are not done yet: different claims, the first five as the rule has it, each with its
    quote; valid if all quotes are found, partial if not, rejected without a claim."""
    done = load(spark, d, "labels").where("quality = 0").select("doc_id")
    rows = quotes(spark, d).join(done, "doc_id", "left_anti")
    flat = F.regexp_replace(F.lower("quote"), r"(?U)\s+", "")
    told = anchored(rows).withColumn("q", flat).where(F.length("q") >= 5)
    claims = told.groupBy("doc_id", F.trim(F.substring("q", 1, 30)).alias("claim")).agg(F.min(F.struct("i", "tier")).alias("x"))
    five = claims.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("x.i"))).where("n <= 5")
    counts = five.groupBy("doc_id").agg(F.count("*").alias("k"), F.count("x.tier").alias("a"))
    k, a = F.coalesce("k", F.lit(0)), F.coalesce("a", F.lit(0))
    status = F.when(k == 0, "rejected").when(a < k, "partial").otherwise("valid")
    return rows.select("doc_id").join(counts, "doc_id", "left").select("doc_id", k.alias("takeaways"), a.alias("anchored"), status.alias("status"))


@query(r"""
WITH copies AS (SELECT min(doc_id) AS first, md5(text) AS sha FROM documents GROUP BY md5(text))
SELECT d.doc_id, CASE WHEN contains(lower(text), 'license') AND n_chars < 400 THEN 'skip_admin' WHEN length(trim(text)) < 100 THEN 'skip_scanned' WHEN d.doc_id <> c.first THEN 'skip_exists' WHEN l.doc_id IS NOT NULL AND l.quality IS NULL THEN 'skip_untagged'
  WHEN l.toxic = 1 THEN 'skip_blocked' WHEN l.quality = 0 THEN 'skip_non_research' ELSE 'ok' END AS outcome, CASE WHEN contains(lower(text), 'license') AND n_chars < 400 OR length(trim(text)) < 100 OR d.doc_id <> c.first THEN 'before_tag' WHEN l.quality IS NULL AND l.doc_id IS NOT NULL OR l.toxic = 1 OR l.quality = 0 THEN 'after_tag' ELSE 'stored' END AS stage
FROM documents d JOIN copies c ON c.sha = md5(text) LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def ingest_gate(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each document on its way in: the cheap gates first, then those that need its tags."""
    sha = F.md5(F.col("text").cast("binary"))
    docs = load(spark, d, "documents").select("doc_id", "text", "n_chars", sha.alias("sha"))
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("first"))
    tags = load(spark, d, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("tagged"))
    rows = docs.withColumn("admin", F.lower("text").contains("license") & (F.col("n_chars") < 400)).withColumn("scanned", F.length(F.trim("text")) < 100).drop("text")
    rows = rows.join(first, "sha").join(tags, "doc_id", "left")
    before = F.when(F.col("admin"), "skip_admin").when(F.col("scanned"), "skip_scanned").when(F.col("doc_id") != F.col("first"), "skip_exists")
    after = F.when(F.col("tagged") & F.col("quality").isNull(), "skip_untagged").when(F.col("toxic") == 1, "skip_blocked").when(F.col("quality") == 0, "skip_non_research")
    stage = F.when(before.isNotNull(), "before_tag").when(after.isNotNull(), "after_tag").otherwise("stored")
    return rows.select("doc_id", F.coalesce(before, after, F.lit("ok")).alias("outcome"), stage.alias("stage"))


PAGES = """
WITH turns AS (SELECT conv_id, turn, unnest([1, 2, 3]) AS b, unnest([CASE WHEN conv_id % 3 = 0 THEN 'Head of ' || conv_id ELSE role END, text, CASE WHEN turn % 2 = 0 THEN 'Foot' ELSE 'page ' || turn END]) AS t FROM conversations),
counted AS (SELECT conv_id, count(DISTINCT turn) AS pages FROM turns GROUP BY 1), seen AS (SELECT conv_id, t, count(DISTINCT turn) AS n FROM turns WHERE b <> 2 GROUP BY 1, 2)
"""


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, b, t: conversations as documents whose turns are pages of three blocks, a head, a body and a foot."""
    head = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Head of "), F.col("conv_id").cast("string"))).otherwise(F.col("role"))
    foot = F.when(F.col("turn") % 2 == 0, "Foot").otherwise(F.concat(F.lit("page "), F.col("turn").cast("string")))
    return load(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.array(head, F.col("text"), foot)).alias("b", "t")).select("conv_id", "turn", (F.col("b") + 1).alias("b"), "t")


def typed_blocks(blocks: DataFrame, least: int = 2, share: float = 0.3) -> DataFrame:
    """blocks with kind: a block at the top or foot of so many pages that its text repeats there; the first head stays."""
    pages = blocks.groupBy("conv_id").agg(F.countDistinct("turn").alias("pages"))
    seen = blocks.where("b <> 2").groupBy("conv_id", "t").agg(F.countDistinct("turn").alias("n"))
    rows = blocks.join(pages, "conv_id").join(seen, ["conv_id", "t"], "left")
    often = (F.col("pages") >= least) & (F.coalesce("n", F.lit(0)) >= F.greatest(F.lit(least), F.floor(share * F.col("pages"))))
    nth = F.row_number().over(Window.partitionBy("conv_id", "b", "t").orderBy("turn"))
    kind = F.when(often & (F.col("b") == 3), "footer").when(often & (F.col("b") == 1) & (nth > 1), "header").otherwise("paragraph")
    return rows.select("conv_id", "turn", "b", "t", kind.alias("kind"))


@query(PAGES + """
SELECT u.conv_id, turn, CAST(b AS INTEGER) AS b, CASE WHEN b <> 2 AND pages >= 2 AND n >= greatest(2, floor(0.3 * pages)) THEN CASE WHEN b = 3 THEN 'footer' WHEN row_number() OVER (PARTITION BY u.conv_id, b, u.t ORDER BY turn) > 1 THEN 'header' ELSE 'paragraph' END ELSE 'paragraph' END AS kind
FROM turns u JOIN counted c ON c.conv_id = u.conv_id LEFT JOIN seen s ON s.conv_id = u.conv_id AND s.t = u.t
""")
def page_headers(spark: SparkSession, d: str) -> DataFrame:
    """Heads and feet that repeat over the pages of a document, told from its text by place and number."""
    return typed_blocks(page_blocks(spark, d)).select("conv_id", "turn", "b", "kind")


@query(PAGES + """
, kept AS (SELECT conv_id, turn, b, t, CAST(sum(length(t) + 2) OVER (PARTITION BY conv_id ORDER BY turn, b) - length(t) - 2 AS BIGINT) AS start FROM turns)
SELECT conv_id, turn, CAST(b AS INTEGER) AS b, start, start + length(t) AS stop FROM kept
""")
def serialised_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of a document in total order, with the places that they take in its text, two characters apart."""
    n = F.length("t")
    end = F.sum(n + 2).over(Window.partitionBy("conv_id").orderBy("turn", "b"))
    rows = page_blocks(spark, d).withColumn("start", end - n - 2)
    return rows.select("conv_id", "turn", "b", "start", (F.col("start") + n).alias("stop"))


SECRET = r"(token|password|secret)(\s*[=:]\s*)\"?[A-Za-z0-9_\-]{8,}\"?"


@query(r"""
SELECT doc_id, md5(t) AS digest, t <> text AS masked, substr(regexp_replace(t, '\s+', ' ', 'g'), 1, 80) AS snippet FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0E-\x1F\x7F]', '', 'g'),
  '(token|password|secret)(\s*[=:]\s*)"?[A-Za-z0-9_\-]{8,}"?', '\1\2***', 'g'), '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+', '<email>', 'g'), '\+?\d[\d ()-]{8,}\d', '<number>', 'g') AS t FROM documents)
""")
def masked_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Texts without control characters, secrets, addresses and long numbers, and the beginning of each to show."""
    t = F.regexp_replace(F.regexp_replace("text", r"[\x00-\x08\x0E-\x1F\x7F]", ""), SECRET, "$1$2***")
    t = F.regexp_replace(F.regexp_replace(t, r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+", "<email>"), r"\+?\d[\d ()-]{8,}\d", "<number>")
    rows = load(spark, d, "documents").select("doc_id", "text", t.alias("t"))
    return rows.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), (F.col("t") != F.col("text")).alias("masked"), F.substring(F.regexp_replace("t", r"\s+", " "), 1, 80).alias("snippet"))


@query(r"""
WITH said AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Draft. ' || text[1:20] || '## Answer' || chr(10) || text WHEN 1 THEN text || chr(10) || '[SOURCES]' || chr(10) || '- A | https://a.example/' || turn || chr(10) || '- none' || chr(10) || '- | http://b.example' || chr(10) || 'x | ftp://c' ELSE text END AS t FROM conversations),
cut AS (SELECT *, split_part(t, '[SOURCES]', 1) AS body, CASE WHEN contains(t, '[SOURCES]') THEN t[instr(t, '[SOURCES]') + 9:] ELSE '' END AS tail FROM said),
seam AS (SELECT *, length(regexp_extract(body, '^(?s:(.*?[^\n#]))#{1,3} ', 1)) AS place FROM cut)
SELECT conv_id, turn, md5(regexp_replace(CASE WHEN place > 0 AND place < length(body) - place THEN body[place + 1:] ELSE body END, '\s+$', '')) AS body, CAST(len(list_filter(string_split(tail, chr(10)), lambda x: regexp_matches(x, '\|\s*https?://'))) AS INTEGER) AS sources, place > 0 AND place < length(body) - place AS dropped FROM seam
""")
def answer_parts(spark: SparkSession, d: str) -> DataFrame:
    """Answers cut at their sentinel into body and sources, with the draft before a late heading left out if it is the
    lesser part; sources without an address that can be opened don't count."""
    text, turn = F.col("text"), F.col("turn")
    listed = F.concat(text, F.lit("\n[SOURCES]\n- A | https://a.example/"), turn.cast("string"), F.lit("\n- none\n- | http://b.example\nx | ftp://c"))
    said = F.when(turn % 3 == 0, F.concat(F.lit("Draft. "), F.substring(text, 1, 20), F.lit("## Answer\n"), text)).when(turn % 3 == 1, listed).otherwise(text)
    rows = load(spark, d, "conversations").select("conv_id", "turn", F.split(said, r"\[SOURCES\]", 2).alias("p"))
    rows = rows.select("conv_id", "turn", F.col("p")[0].alias("body"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("tail"))
    at = F.length(F.regexp_extract("body", r"^(?s:(.*?[^\n#]))#{1,3} ", 1))
    rows = rows.withColumn("at", at).withColumn("dropped", (F.col("at") > 0) & (F.col("at") < F.length("body") - F.col("at")))
    body = F.when(F.col("dropped"), F.substring(F.col("body"), F.col("at") + 1, F.length("body"))).otherwise(F.col("body"))
    sources = F.size(F.filter(F.split("tail", "\n"), lambda x: x.rlike(r"\|\s*https?://")))
    return rows.select("conv_id", "turn", F.md5(F.regexp_replace(body, r"\s+\z", "").cast("binary")).alias("body"), sources.alias("sources"), "dropped")


def stream_filter(chunks: Column, allowed: Column) -> Column:
    """Text that came in chunks, with the citations that are not allowed replaced. A citation may be cut by a chunk's end,
    so that what may be the beginning of one waits for the next chunk."""
    mark = lambda s: F.regexp_replace(s, r"\[(\d+)\]", "[$1]")
    waits = r"\[\d*\z"

    def feed(state: Column, chunk: Column) -> Column:
        data = F.concat(state["wait"], chunk)
        tail = F.regexp_extract(data, f"({waits})", 1)
        return F.struct(F.concat(state["out"], mark(F.substring(data, F.lit(1), F.length(data) - F.length(tail)))).alias("out"), tail.alias("wait"))

    fed = F.aggregate(chunks, F.struct(F.lit("").alias("out"), F.lit("").alias("wait")), feed, lambda s: F.concat(s["out"], s["wait"]))
    parts = F.regexp_extract_all(fed, F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.aggregate(F.array_distinct(parts), fed, lambda s, n: F.when(F.array_contains(allowed, n.cast("int")), s).otherwise(F.replace(s, F.concat(F.lit("["), n, F.lit("]")), F.lit("[?]"))))


@query(r"""
SELECT conv_id, turn, md5(replace(t, '[' || (turn * 3 % 7) || ']', CASE WHEN turn * 3 % 7 IN (1, 2, 3) THEN '[' || (turn * 3 % 7) || ']' ELSE '[?]' END)) AS digest FROM (
  SELECT conv_id, turn, text[1:37] || '[' || (turn * 3 % 7) || ']' || text[38:] AS t FROM conversations WHERE NOT regexp_matches(text, '\[\d+\]'))
""")
def chunked_citations(spark: SparkSession, d: str) -> DataFrame:
    """Turns that came in chunks of ten characters, with a citation across a chunk's end, without the citations of sources
    that were not given."""
    mark = F.concat(F.lit("["), (F.col("turn") * 3 % 7).cast("string"), F.lit("]"))
    t = F.concat(F.substring(F.col("text"), F.lit(1), F.lit(37)), mark, F.substring(F.col("text"), F.lit(38), F.length("text")))
    rows = load(spark, d, "conversations").where(~F.col("text").rlike(r"\[\d+\]")).select("conv_id", "turn", t.alias("t"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 10).cast("int")), lambda i: F.substring(F.col("t"), i * 10 + 1, F.lit(10)))
    return rows.select("conv_id", "turn", F.md5(stream_filter(chunks, F.array(F.lit(1), F.lit(2), F.lit(3))).cast("binary")).alias("digest"))
