"""Scalar text rules over the tables: parsing, normalising, scrubbing, citations, tables, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.plans.registry import query
from corpusmill.sources.tables import load


@query(r"""
SELECT part.p_partkey, try_cast(regexp_replace(regexp_replace('$ ' || p_retailprice || ' USD', '[$,]', '', 'g'), '[A-Z ]+', '', 'g') AS DOUBLE) AS amount,
  try_cast(nullif(regexp_extract('FY' || (1990 + p_size) || 'E', '((19|20)\d\d)', 1), '') AS INTEGER) AS year, try_cast('n/a' || p_size AS DOUBLE) AS bad FROM part
""")
def price_texts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers out of text with currency signs and units; years; null for what is none."""
    amount = F.regexp_replace(F.regexp_replace(F.concat(F.lit("$ "), F.col("p_retailprice").cast("string"), F.lit(" USD")), "[$,]", ""), "[A-Z ]+", "")
    year = F.nullif(F.regexp_extract(F.concat(F.lit("FY"), (1990 + F.col("p_size")).cast("string"), F.lit("E")), r"((19|20)\d\d)", 1), F.lit(""))
    return load(spark, d, "part").select("p_partkey", amount.try_cast("double").alias("amount"), year.try_cast("int").alias("year"), F.concat(F.lit("n/a"), F.col("p_size").cast("string")).try_cast("double").alias("bad"))


@query(r"SELECT doc_id, substr(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), 1, 120) AS head FROM documents")
def collapse_truncate(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.substring(F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")), 1, 120).alias("head"))


@query(r"""
SELECT doc_id, list_transform(list_filter([struct_pack(at := instr(t, k), k := k) FOR k IN ['the', 'der', 'les', 'que']], lambda x: x.at > 0), lambda x: x.k)[list_position(
  list_transform(list_filter([struct_pack(at := instr(t, k), k := k) FOR k IN ['the', 'der', 'les', 'que']], lambda x: x.at > 0), lambda x: x.at),
  list_min(list_transform(list_filter([struct_pack(at := instr(t, k), k := k) FOR k IN ['the', 'der', 'les', 'que']], lambda x: x.at > 0), lambda x: x.at)))] AS issuer
FROM (SELECT doc_id, lower(text) AS t FROM documents)
""")
def first_signature(spark: SparkSession, d: str) -> DataFrame:
    """The signature that occurs first in a text."""
    t = F.lower("text")
    found = F.filter(F.array(*[F.struct(F.instr(t, k).alias("at"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(("the", "der", "les", "que"))]), lambda x: x["at"] > 0)
    return load(spark, d, "documents").select("doc_id", F.get(F.array_sort(found), F.lit(0))["k"].alias("issuer"))


CITED = r"""
WITH cited AS (SELECT conv_id, turn, text || ' [' || (turn + 1) || '] and [' || (turn * 3 % 7) || ']' AS t FROM conversations)
"""


def cited(spark: SparkSession, d: str) -> DataFrame:
    """Turns with two citations each, as an answer would bear them."""
    mark = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))
    return load(spark, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" "), mark(F.col("turn") + 1), F.lit(" and "), mark(F.col("turn") * 3 % 7)).alias("t"))


@query(CITED + r"""
SELECT conv_id, turn, list_transform(regexp_extract_all(t, '\[(\d+)\]', 1), lambda x: CAST(x AS INTEGER)) AS cites, CAST(len(list_filter(regexp_extract_all(t, '\[(\d+)\]', 1), lambda x: CAST(x AS INTEGER) > 4)) AS INTEGER) AS unknown,
  regexp_replace(t, '\[([5-9]|\d\d+)\]', '[?]', 'g') AS shown FROM cited
""")
def citation_marks(spark: SparkSession, d: str) -> DataFrame:
    """Citation numbers, how many are unknown (above 4), and the text with these replaced."""
    cites = F.transform(F.regexp_extract_all("t", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    return cited(spark, d).select("conv_id", "turn", cites.alias("cites"), F.size(F.filter(cites, lambda x: x > 4)).alias("unknown"), F.regexp_replace("t", r"\[([5-9]|\d\d+)\]", "[?]").alias("shown"))


@query(CITED + r"""
, marks AS (SELECT conv_id, turn, CAST(x AS INTEGER) AS old, i FROM (SELECT conv_id, turn, unnest(regexp_extract_all(t, '\[(\d+)\]', 1)) AS x, generate_subscripts(regexp_extract_all(t, '\[(\d+)\]', 1), 1) AS i FROM cited)),
first AS (SELECT conv_id, old, min(struct_pack(turn, i)) AS pos FROM marks GROUP BY 1, 2)
SELECT conv_id, old, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS INTEGER) AS new FROM first
""")
def renumber_evidence(spark: SparkSession, d: str) -> DataFrame:
    """New numbers by first appearance in a conversation."""
    marks = cited(spark, d).select("conv_id", "turn", F.posexplode(F.regexp_extract_all("t", F.lit(r"\[(\d+)\]"), F.lit(1))).alias("i", "x"))
    first = marks.groupBy("conv_id", F.col("x").cast("int").alias("old")).agg(F.min(F.struct("turn", "i")).alias("at"))
    return first.select("conv_id", "old", F.row_number().over(Window.partitionBy("conv_id").orderBy("at")).alias("new"))


@query(r"""
SELECT doc_id, regexp_matches(text, '\d+(\.\d+)?\s?(%|USD|EUR|million)|[$€]\s?\d') AS claims, CAST(len(regexp_extract_all(text, '\d+')) AS INTEGER) AS numbers FROM documents
""")
def number_mentions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.col("text").rlike(r"\d+(\.\d+)?\s?(%|USD|EUR|million)|[$€]\s?\d").alias("claims"), F.regexp_count("text", F.lit(r"\d+")).alias("numbers"))


@query(r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0E-\x1F]', '', 'g'), '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+', '<email>', 'g'), '\d{9,}', '<number>', 'g')) AS digest FROM documents
""")
def scrub_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Control characters, addresses and long numbers masked."""
    t = F.regexp_replace("text", r"[\x00-\x08\x0E-\x1F]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+", "<email>"), r"\d{9,}", "<number>")
    return load(spark, d, "documents").select("doc_id", F.md5(t.cast("binary")).alias("digest"))


@query(r"SELECT page_id, substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 80) AS name FROM pages")
def sanitize_filename(spark: SparkSession, d: str) -> DataFrame:
    name = F.regexp_replace(F.regexp_replace("url", r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return load(spark, d, "pages").select("page_id", F.substring(name, 1, 80).alias("name"))


@query(r"""
SELECT doc_id, CAST(count(*) AS BIGINT) AS table_lines, md5(string_agg('| ' || replace(line, '|', '\|') || ' |', chr(10) ORDER BY i)) AS markdown FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE len(line) - len(replace(line, '|', '')) >= 2 GROUP BY doc_id
""")
def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Lines that look like table rows, escaped."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    cells = F.transform(lines, lambda x: F.concat(F.lit("| "), F.replace(x, F.lit("|"), F.lit("\\|")), F.lit(" |")))
    rows = load(spark, d, "documents").select("doc_id", cells.alias("c")).where(F.size("c") > 0)
    return rows.select("doc_id", F.size("c").cast("long").alias("table_lines"), F.md5(F.array_join("c", "\n").cast("binary")).alias("markdown"))


@query(r"SELECT item_id, md5(regexp_replace(text, '(the|and)', '<b>\1</b>', 'gi')) AS digest FROM benchmark")
def highlight_terms(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select("item_id", F.md5(F.regexp_replace("text", "(?i)(the|and)", "<b>$1</b>").cast("binary")).alias("digest"))


@query("""
WITH parts AS (SELECT source, doc_id // 1000 AS part, sha256(string_agg(md5(text), '' ORDER BY doc_id)) AS h, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, sha256(string_agg(h, '' ORDER BY part)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM parts GROUP BY source
""")
def source_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """One digest of a source's texts in order: of the digests of its parts, each a thousand ids wide, so that a group holds
    a part's digests or the parts', never all of a source."""
    rows = load(spark, d, "documents").select("source", "doc_id", F.floor(F.col("doc_id") / 1000).alias("part"), F.md5(F.col("text").cast("binary")).alias("h"))
    joined = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), "").cast("binary"), 256)
    parts = rows.groupBy("source", "part").agg(joined("doc_id").alias("h"), F.count("*").alias("n"))
    return parts.groupBy("source").agg(joined("part").alias("fingerprint"), F.sum("n").alias("n"))


@query("""
SELECT p_partkey, w[1] AS head, w[len(w)] AS tail, list_transform(generate_series(2, least(6, length(p_brand))), lambda n: substr(p_brand, 1, n)) AS prefixes FROM (SELECT p_partkey, p_brand, string_split(p_type, ' ') AS w FROM part)
""")
def brand_prefixes(spark: SparkSession, d: str) -> DataFrame:
    w = F.split("p_type", " ")
    grams = F.transform(F.sequence(F.lit(2), F.least(F.lit(6), F.length("p_brand"))), lambda n: F.substring(F.col("p_brand"), F.lit(1), n))
    return load(spark, d, "part").select("p_partkey", F.element_at(w, 1).alias("head"), F.element_at(w, -1).alias("tail"), grams.alias("prefixes"))


@query(r"""
SELECT conv_id, turn, split_part(t, '==', 1) AS body, CASE WHEN contains(t, '==') THEN split_part(t, '==', 2) END AS sources FROM (
  SELECT conv_id, turn, text || CASE WHEN turn % 2 = 1 THEN '==src ' || turn ELSE '' END AS t FROM conversations WHERE NOT contains(text, '=='))
""")
def split_sources(spark: SparkSession, d: str) -> DataFrame:
    """An answer cut at its sentinel into body and sources."""
    t = F.concat("text", F.when(F.col("turn") % 2 == 1, F.concat(F.lit("==src "), F.col("turn").cast("string"))).otherwise(""))
    rows = load(spark, d, "conversations").where(~F.col("text").contains("==")).select("conv_id", "turn", F.split(t, "==").alias("p"))
    return rows.select("conv_id", "turn", F.col("p")[0].alias("body"), F.get("p", F.lit(1)).alias("sources"))


@query("""
WITH lines AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
hits AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 3 THEN 0 ELSE 1 END AS fresh FROM lines WHERE contains(line, '|')),
marked AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cluster FROM hits)
SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, CAST(min(i) AS INTEGER) AS first_line, CAST(max(i) AS INTEGER) AS last_line, count(*) AS n FROM marked GROUP BY doc_id, cluster HAVING count(*) >= 3
""")
def index_tables(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of at least three table lines with gaps of at most three lines."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).where(F.col("line").contains("|")).select("doc_id", (F.col("p") + 1).alias("i"))
    of = Window.partitionBy("doc_id").orderBy("i")
    hits = lines.withColumn("fresh", F.when(F.col("i") - F.lag("i").over(of) <= 3, 0).otherwise(1))
    marked = hits.withColumn("cluster", F.sum("fresh").over(of.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy("doc_id", "cluster").agg(F.min("i").alias("first_line"), F.max("i").alias("last_line"), F.count("*").alias("n")).where("n >= 3")


@query("""
SELECT user_id % 20 AS unit, greatest(1, least(100, CAST(ceil(sum(value) / 5000) AS INTEGER) * 1)) AS need, list_min(list_filter([1, 2, 4, 8, 16, 32, 64, 128], lambda s: s >= ceil(sum(value) / 5000))) AS step FROM events GROUP BY 1
""")
def round_to_step(spark: SparkSession, d: str) -> DataFrame:
    """The least offered size that covers a need."""
    rows = load(spark, d, "events").groupBy((F.col("user_id") % 20).alias("unit")).agg(F.ceil(F.sum("value") / 5000).cast("int").alias("n"))
    steps = F.filter(F.array(*[F.lit(s) for s in (1, 2, 4, 8, 16, 32, 64, 128)]), lambda s: s >= F.col("n"))
    return rows.select("unit", F.greatest(F.lit(1), F.least(F.lit(100), F.col("n"))).alias("need"), F.array_min(steps).alias("step"))


@query("""
SELECT event_type, round((last - first) / greatest(1, days), 6) AS per_day, round(last + 365 * (last - first) / greatest(1, days), 4) AS in_a_year FROM (
  SELECT event_type, arg_min(value, struct_pack(a := ts, b := event_id)) AS first, arg_max(value, struct_pack(a := ts, b := event_id)) AS last, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS days FROM events GROUP BY 1)
""")
def linear_growth(spark: SparkSession, d: str) -> DataFrame:
    """Growth between the first and last sample, carried on for a year."""
    at = F.struct("ts", "event_id")
    rows = load(spark, d, "events").groupBy("event_type").agg(F.min_by("value", at).alias("a"), F.max_by("value", at).alias("b"), F.datediff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))).alias("days"))
    rate = (F.col("b") - F.col("a")) / F.greatest(F.lit(1), F.col("days"))
    year = F.col("b") + 365 * (F.col("b") - F.col("a")) / F.greatest(F.lit(1), F.col("days"))
    return rows.select("event_type", F.round(rate, 6).alias("per_day"), F.round(year, 4).alias("in_a_year"))


@query("""
SELECT conv_id, len(list_filter(want, lambda x: NOT list_contains(got, x))) = 0 AND len(list_filter(got, lambda x: NOT list_contains(want, x))) = 0 AS valid FROM (
  SELECT conv_id, list(turn) AS got, generate_series(0, max(turn)) AS want FROM conversations GROUP BY conv_id)
""")
def judged_index_set(spark: SparkSession, d: str) -> DataFrame:
    """Whether the indices of an answer are just those expected."""
    rows = load(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("turn").alias("got"), F.max("turn").alias("m"))
    want = F.sequence(F.lit(0).cast("long"), F.col("m"))
    return rows.select("conv_id", ((F.size(F.array_except(want, "got")) == 0) & (F.size(F.array_except("got", want)) == 0)).alias("valid"))


@query("""
SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INTEGER) AS number, doc_id = max(doc_id) OVER () AS is_latest FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15)
""")
def build_context(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents numbered, the newest marked."""
    top = load(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(15).select("doc_id", "n_chars")
    one = Window.partitionBy(F.lit(0))  # fifteen rows
    return top.select("doc_id", F.row_number().over(one.orderBy(F.desc("n_chars"), "doc_id")).alias("number"), (F.col("doc_id") == F.max("doc_id").over(one)).alias("is_latest"))


@query("""
SELECT term FROM (SELECT term, count(*) AS n FROM (SELECT unnest(['the', 'thea', 'in', 'and']) AS term), documents WHERE starts_with(lower(text), term) GROUP BY term) ORDER BY n DESC, length(term), term LIMIT 1
""")
def lead_term(spark: SparkSession, d: str) -> DataFrame:
    """The term that most texts begin with, the shortest of those."""
    t = F.lower("text")
    begun = F.array_compact(F.array(*[F.when(t.startswith(k), F.lit(k)) for k in ("the", "thea", "in", "and")]))
    counts = load(spark, d, "documents").select(F.explode(begun).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.length("term"), "term").limit(1).select("term")
