"""Text scalars and the text pipeline: normalising, chunking, boilerplate, scores, exact copies; dates; JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import textfns
from corpusmill.plans.frames import checkpointed
from corpusmill.plans.registry import query
from corpusmill.sources.tables import load


@query(r"SELECT doc_id, md5(n) AS digest, CAST(length(n) AS BIGINT) AS n_chars FROM (SELECT doc_id, regexp_replace(lower(text), '\s+', '', 'g') AS n FROM documents)")
def norm_match(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("doc_id", textfns.norm_for_match("text").alias("n"))
    return rows.select("doc_id", F.md5(F.col("n").cast("binary")).alias("digest"), F.length("n").cast("long").alias("n_chars"))


#: White space, as the normal form of lines drops it.
SPACES = r"[\s\x0B]+"
#: Texts with CJK characters, gaps between them, empty lines and NUL, which the given tables lack.
SAMPLES = ["台 積 電\n 公布 財報", "AI 伺服器\t\t需求  強勁\n\n \n第二 段　落", " a  b\n\n\nc\td ", "ＡＩ伺服器 AI 伺服器", "\n\n", "半 導體 chip 供 應 鏈"]
_SAMPLES = "(VALUES " + ", ".join("('" + s.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "')" for s in SAMPLES) + ") AS s(text)"
#: The same with -1, -2, ... for doc_id, beside the documents.
_TEXTS = f"texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT -row_number() OVER (), text FROM {_SAMPLES})"
_CJK, _WS = r"[\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]", r"[\s\x{0B}\x{85}\x{A0}\x{3000}]"
#: Without look-around a CJK character can stand on one side of a match only, so the gaps go in two passes.
_JOIN = lambda t: f"regexp_replace(regexp_replace({t}, '({_CJK}){_WS}+({_CJK})', '\\1\\2', 'g'), '({_CJK}){_WS}+({_CJK})', '\\1\\2', 'g')"


def texts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text of the documents and the samples."""
    more = spark.createDataFrame([(-1 - i, s) for i, s in enumerate(SAMPLES)], "doc_id long, text string")
    return load(spark, d, "documents").select("doc_id", "text").union(more)


@query(f"""
WITH {_TEXTS} SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace({_JOIN("text")}, '[ \\t]{{2,}}', ' ', 'g'), '{_WS}*\\n{_WS}*', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g')) AS digest FROM texts
""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts as passages: gaps between CJK characters closed, blanks squeezed, lines joined."""
    return texts(spark, d).select("doc_id", F.md5(textfns.clean_text(F.col("text")).cast("binary")).alias("digest"))


@query(f"""
WITH {_TEXTS} SELECT doc_id, md5(array_to_string(list_transform(list_filter(regexp_split_to_array(replace(text, chr(0), ''), '\\n\\s*\\n'), lambda p: regexp_replace(p, '{_WS}+', '', 'g') <> ''),
  lambda p: regexp_replace(regexp_replace({_JOIN("p")}, '[ \\t]{{2,}}', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g')), chr(10) || chr(10))) AS digest FROM texts
""")
def clean_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Texts as they are stored: cleaned paragraph by paragraph, borders kept."""
    return texts(spark, d).select("doc_id", F.md5(textfns.clean_extracted(F.col("text")).cast("binary")).alias("digest"))


@query(f"""
WITH asked AS (SELECT item_id, text FROM benchmark UNION ALL SELECT 1000000 + conv_id * 100 + turn, text FROM conversations UNION ALL SELECT -row_number() OVER (), text FROM {_SAMPLES}),
norm AS (SELECT item_id, regexp_replace(translate(lower(text), 'ａｉ', 'ai'), '{_WS}+', '', 'g') AS phrase FROM asked WHERE text NOT LIKE 'ＡＩ%')
SELECT item_id, md5(phrase) AS phrase, list_filter(t, lambda x, i: list_position(t, x) = i) AS terms FROM (SELECT item_id, phrase, regexp_extract_all(phrase, '[a-z0-9]+|[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}]+') AS t FROM norm)
""")
def extract_terms(spark: SparkSession, d: str) -> DataFrame:
    """The phrase of a question in normal form and the runs of letters or CJK characters in it."""
    turns = load(spark, d, "conversations").select((1_000_000 + F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), "text")
    asked = load(spark, d, "benchmark").select("item_id", "text").union(turns).union(texts(spark, d).where("doc_id < 0"))
    rows = asked.where("text not like 'ＡＩ%'").select("item_id", textfns.norm_for_match("text").alias("p"))
    return rows.select("item_id", F.md5(F.col("p").cast("binary")).alias("phrase"), textfns.terms_of(F.col("p")).alias("terms"))


@query(r"""
SELECT doc_id, CASE WHEN c = 0 AND l = 0 THEN 'unknown' WHEN c >= 2 * l THEN 'zh' WHEN l >= 2 * c THEN 'en' ELSE 'mixed' END AS script FROM (
  SELECT doc_id, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) AS c, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)
""")
def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", textfns.script_language(F.col("text")).alias("script"))


#: Own sentences in both scripts, a name of the one in the other, one long text with two of them.
SCRIPTS = ["国务院发布新规定", "國務院發布新規定", "恒大集團與鴻海簽約", "会", "实际 revenue", "這份報告提到" * 20 + "恒耀与", "日本語の文章", "plain"]


@query(rf"""
WITH said AS (SELECT text AS raw FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT unnest({SCRIPTS!r})),
counted AS (SELECT raw, length(raw) - length(translate(raw, '{textfns.SIMPLIFIED}', '')) AS simplified, len(regexp_extract_all(raw, '[\x{{4E00}}-\x{{9FFF}}]')) AS han FROM said)
SELECT md5(raw) AS digest, simplified, han, simplified >= 2 AND simplified >= 0.05 * han AS looks_simplified, count(*) AS n FROM counted GROUP BY ALL
""")
def script_detect(spark: SparkSession, d: str) -> DataFrame:
    """Which script texts with CJK characters are written in."""
    said = load(spark, d, "documents").select(F.col("text").alias("raw")).union(load(spark, d, "conversations").select("text")).union(spark.createDataFrame([(x,) for x in SCRIPTS], "raw string"))
    raw = F.col("raw")
    han = F.regexp_count(raw, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    told = said.select(F.md5(raw.cast("binary")).alias("digest"), textfns.simplified_count(raw).cast("long").alias("simplified"), han.cast("long").alias("han"), textfns.looks_simplified(raw).alias("looks_simplified"))
    return told.groupBy("digest", "simplified", "han", "looks_simplified").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\x{E000}-\x{F8FF}\x{FFFD}]')) / length(text) AS garbled FROM documents")
def garbled_ratio(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", textfns.garbled_ratio(F.col("text")).alias("garbled"))


@query(r"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '/([^/?#]*)(\?[^#]*)?(#.*)?$', 1) AS leaf,
  CAST(len(regexp_extract_all(html, '<a href="[^"]*"')) AS INTEGER) AS links FROM pages
""")
def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    """Parts of an address and the number of links on the page."""
    part = lambda p: F.regexp_extract("url", p, 1)
    return load(spark, d, "pages").select(
        "page_id", part("^([a-z]+)://").alias("scheme"), part("^[a-z]+://([^/?#]+)").alias("host"), part(r"/([^/?#]*)(\?[^#]*)?(#.*)?$").alias("leaf"), F.regexp_count("html", F.lit('<a href="[^"]*"')).alias("links"),
    )


@query("""
SELECT o_orderkey, CASE lower(substr(o_orderpriority, 3)) WHEN 'urgent' THEN 2 WHEN 'high' THEN 1 WHEN 'medium' THEN 0 WHEN 'not specified' THEN -1 WHEN 'low' THEN -2 END AS rating, CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands FROM orders
""")
def priority_rating(spark: SparkSession, d: str) -> DataFrame:
    ratings = {"urgent": 2, "high": 1, "medium": 0, "not specified": -1, "low": -2}
    mapping = F.create_map(*[F.lit(x) for kv in ratings.items() for x in kv])
    return load(spark, d, "orders").select("o_orderkey", F.try_element_at(mapping, F.lower(F.substring("o_orderpriority", 3, 99))).alias("rating"), F.floor(F.col("o_totalprice") / 1000).alias("thousands"))


@query(r"SELECT page_id, try_cast(regexp_extract(url, '/(\d+)', 1) AS BIGINT) AS number, nullif(regexp_extract(url, '[?&]page=(\d+)', 1), '') AS page, nullif(regexp_extract(url, '/(en|fr|de|es)/', 1), '') AS lang FROM pages")
def url_fields(spark: SparkSession, d: str) -> DataFrame:
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return load(spark, d, "pages").select("page_id", part(r"/(\d+)").try_cast("long").alias("number"), part(r"[?&]page=(\d+)").alias("page"), part("/(en|fr|de|es)/").alias("lang"))


@query(rf"""
WITH {_TEXTS} SELECT doc_id, CAST(round_even(cjk * 0.8::DOUBLE + greatest(length(text) - cjk - blank, 0) / 3.5::DOUBLE, 0) AS BIGINT) AS tokens FROM (
  SELECT doc_id, text, len(regexp_extract_all(text, '[\x{{2E80}}-\x{{2FDF}}\x{{3000}}-\x{{312F}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{FF00}}-\x{{FFEF}}]')) AS cjk, len(regexp_extract_all(text, '{_WS}')) AS blank FROM texts)
""")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", textfns.token_estimate(F.col("text")).alias("tokens"))


@query("""
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(substr(text, 1 + 520 * i, 600)) AS digest FROM (
  SELECT doc_id, text, unnest(generate_series(0, greatest(0, CAST(ceil((length(text) - 600) / 520.0) AS BIGINT)))) AS i FROM documents)
""")
def chunk_window(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 600 characters every 520."""
    return chunks(load(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", F.md5(F.col("content").cast("binary")).alias("digest"))


def chunks(docs: DataFrame, size: int = 600, step: int = 520) -> DataFrame:
    """chunk_index, content beside the columns of docs but text: sliding windows over the whole text."""
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / float(step))).cast("int")
    others = [c for c in docs.columns if c != "text"]
    return docs.select(*others, "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index")).select(
        *others, "chunk_index", F.substring(F.col("text"), 1 + step * F.col("chunk_index"), F.lit(size)).alias("content")
    )


@query(r"""
WITH whole AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
cut AS (SELECT doc_id, i, CASE WHEN length(t) <= 600 THEN t ELSE substr(t, 1 + 520 * i, 600) END AS c, CASE WHEN i > 0 THEN right(substr(t, 1 + 520 * (i - 1), 600), 80) ELSE '' END AS tail FROM (
  SELECT doc_id, t, unnest(generate_series(0, CASE WHEN length(t) <= 600 THEN 0 ELSE CAST(ceil(length(t) / 520.0) AS BIGINT) - 1 END)) AS i FROM whole WHERE t <> '' AND NOT regexp_matches(t, '\n\s*\n') AND NOT starts_with(t, '|')))
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, length(x) AS n_chars, md5(x) AS digest FROM (SELECT doc_id, i, regexp_replace(tail || c, '^\s+|\s+$', '', 'g') AS x FROM cut)
""")
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the documents. All of them are one paragraph each, so that SQL can say what their chunks are."""
    rows = load(spark, d, "documents").select("doc_id", F.posexplode(textfns.chunk_text("text")).alias("chunk_index", "content"))
    return rows.select("doc_id", "chunk_index", F.length("content").cast("long").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("digest"))


#: A line in the form in which lines are counted, and the document's code, if it has one.
_NORM = "regexp_replace(lower(line), '\\s+', '', 'g')"
LINES = f"""
lines AS (SELECT doc_id, source, CAST(generate_subscripts(p, 1) AS INTEGER) AS line_no, unnest(p) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents)),
keyed AS (SELECT *, CASE WHEN length({_NORM}) >= 30 THEN sha1({_NORM})[1:16] END AS key FROM lines),
mined AS (SELECT source, key, count(*) AS n_docs, count(DISTINCT code) AS codes, count(*) FILTER (code IS NULL) AS bare FROM (SELECT DISTINCT source, key, doc_id, CASE WHEN doc_id % 2 = 1 THEN doc_id % 10 END AS code FROM keyed WHERE key IS NOT NULL) GROUP BY 1, 2),
kept AS (SELECT m.* FROM mined m JOIN (SELECT source, greatest(8, ceil(count(*) * 0.005)) AS least FROM documents GROUP BY 1) t USING (source) WHERE n_docs >= least AND (codes >= 3 OR bare >= least))
"""


def line_key(line: Column) -> Column:
    """How lines are told apart: a digest of the line in lower case without white space; null for short ones."""
    norm = F.regexp_replace(F.lower(line), SPACES, "")
    return F.when(F.length(norm) >= 30, F.substring(F.sha1(norm.cast("binary")), 1, 16))


def boilerplate(docs: DataFrame, least: int = 8, share: float = 0.005, kinds: int = 3) -> DataFrame:
    """source, key, n_docs of the lines that many documents of a source share and that stand under several codes, or in as
    many documents without one. A document counts once for each line of its, so no distinct count is needed, and a line of
    many documents is pre-aggregated where they lie."""
    keys = F.array_distinct(F.array_compact(F.transform(F.split("text", "\n"), line_key)))
    code = F.when(F.col("doc_id") % 2 == 1, F.col("doc_id") % 10)
    rows = docs.select("source", code.alias("code"), F.explode(keys).alias("key")).groupBy("source", "key", "code").agg(F.count("*").alias("k"))
    counts = rows.groupBy("source", "key").agg(F.sum("k").alias("n_docs"), F.count("code").alias("codes"), F.coalesce(F.sum(F.when(F.col("code").isNull(), F.col("k"))), F.lit(0)).alias("bare"))
    limit = F.greatest(F.lit(least), F.ceil(F.count("*") * share)).alias("least")
    return counts.join(F.broadcast(docs.groupBy("source").agg(limit)), "source").where(f"n_docs >= least and (codes >= {kinds} or bare >= least)").select("source", "key", "n_docs")


@query("WITH" + LINES + "SELECT source, key, n_docs FROM kept")
def boilerplate_mine(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate(load(spark, d, "documents"))


@query("WITH" + LINES + """
SELECT doc_id, CASE WHEN n < 0.2 * length(text) THEN md5(text) ELSE md5(body) END AS digest, n < 0.2 * length(text) AS reverted FROM (
  SELECT d.doc_id, d.text, coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (k.key IS NULL), '') AS body, coalesce(sum(length(l.line)) FILTER (k.key IS NULL), 0) AS n
  FROM documents d JOIN keyed l ON l.doc_id = d.doc_id LEFT JOIN kept k ON k.source = l.source AND k.key = l.key GROUP BY d.doc_id, d.text)
""")
def boilerplate_strip(spark: SparkSession, d: str) -> DataFrame:
    """Texts without their boilerplate lines, unless less than a fifth would be left."""
    return stripped(load(spark, d, "documents").select("doc_id", "source", "text"))


def stripped(docs: DataFrame, bound: int = 50_000) -> DataFrame:
    """doc_id, digest, reverted of docs (doc_id, source, text) without their boilerplate lines. At most bound keys, of all
    sources together, are broadcast, as one array for each source, and lines are dropped in place. More are joined with the
    documents' keys, so that a document comes with those of its own lines that go."""
    keys = checkpointed(boilerplate(docs).select("source", "key"))
    if keys.count() <= bound:
        rows = docs.join(F.broadcast(keys.groupBy("source").agg(F.collect_set("key").alias("keys"))), "source", "left")
    else:
        own = docs.select("source", "doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.explode(F.array_distinct(F.array_compact(F.transform(F.split("text", "\n"), line_key)))).alias("key"))
        gone = own.join(keys, ["source", "key"]).groupBy("source", "doc_id", "h").agg(F.collect_set("key").alias("keys"))
        rows = docs.withColumn("h", F.md5(F.col("text").cast("binary"))).join(gone, ["source", "doc_id", "h"], "left")
    left = F.filter(F.split("text", "\n"), lambda x: ~F.coalesce(F.array_contains("keys", line_key(x)), F.lit(False)))
    rows = rows.select("doc_id", "text", F.when(F.col("keys").isNull(), F.split("text", "\n")).otherwise(left).alias("left"))
    n = F.aggregate("left", F.lit(0), lambda a, x: a + F.length(x))
    rows = rows.select("doc_id", "text", F.array_join("left", "\n").alias("body"), (n < 0.2 * F.length("text")).alias("reverted"))
    return rows.select("doc_id", F.md5(F.when(F.col("reverted"), F.col("text")).otherwise(F.col("body")).cast("binary")).alias("digest"), "reverted")


ROWS = """
WITH rows_ AS (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS i, CASE o_orderkey % 5 WHEN 0 THEN 'Order ' || o_orderkey || ' was placed' WHEN 1 THEN strftime(o_orderdate, '%-m/%-d') || ' item ' || o_orderkey || ' -'
  WHEN 2 THEN strftime(o_orderdate, '%-m/%-d') || ' 401,138 12 -' ELSE strftime(o_orderdate, '%-m/%-d') || ' part ' || o_orderkey || CASE WHEN o_orderpriority < '3' THEN ' Buy' ELSE ' hold on' END END AS line FROM orders)
"""


def reports_of_rows(spark: SparkSession, d: str) -> DataFrame:
    """o_custkey, i, line: each customer's orders as lines of a report, many of them like rows of an index of dates."""
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    key, date = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "M/d")
    kind = F.col("o_orderkey") % 5
    rated = F.concat(date, F.lit(" part "), key, F.when(F.col("o_orderpriority") < "3", " Buy").otherwise(" hold on"))
    line = F.when(kind == 0, F.concat(F.lit("Order "), key, F.lit(" was placed"))).when(kind == 1, F.concat(date, F.lit(" item "), key, F.lit(" -"))).when(kind == 2, F.concat(date, F.lit(" 401,138 12 -"))).otherwise(rated)
    return load(spark, d, "orders").select("o_custkey", i.alias("i"), line.alias("line"))


# Words by which a row shows a rating.
RATED = "買進|持有|賣出|中立|增加持股|降低持股|減少持股|首次評等|重啟評等|未評等|評估中|限制評等|優於大盤|落後大盤|\\b(?:buy|hold|sell|neutral|outperform|underperform|overweight|underweight|equal-?weight)\\b"


@query(ROWS + rf"""
, told AS (SELECT *, regexp_matches(line, '^\s*(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])(\s|$)') AS dated, regexp_matches(lower(line), '{RATED}') AS rated, string_split(trim(line), ' ') AS w FROM rows_ WHERE trim(line) <> ''),
marked AS (SELECT *, dated AND (rated OR (line LIKE '% -' AND len(w) > 2 AND len(list_filter(w[2:-2], lambda x: regexp_matches(x, '^[0-9,.()%+▲▼-]+$'))) <= 1)) AS hit FROM told),
placed AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY i) AS p FROM marked),
gaps AS (SELECT *, p - lag(p) OVER (PARTITION BY o_custkey ORDER BY p) - 1 AS between_ FROM placed WHERE hit),
runs AS (SELECT *, sum(CASE WHEN between_ <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
spans AS (SELECT o_custkey, run, min(i) AS a, max(i) AS b FROM runs GROUP BY 1, 2 HAVING count(*) >= 3 AND bool_or(rated)),
gone AS (SELECT m.o_custkey, m.i FROM marked m JOIN spans s ON s.o_custkey = m.o_custkey AND m.i BETWEEN s.a AND s.b WHERE m.dated),
sums AS (SELECT r.o_custkey, count(*) AS n_lines, count(g.i) AS dropped, coalesce(sum(length(line)) FILTER (g.i IS NULL) + count(*) FILTER (g.i IS NULL) - 1, 0) AS left_, sum(length(line)) + count(*) - 1 AS size FROM rows_ r LEFT JOIN gone g ON g.o_custkey = r.o_custkey AND g.i = r.i GROUP BY 1)
SELECT o_custkey, n_lines, dropped, left_ < 0.5 * size AS reverted FROM sums
""")
def rating_index_strip(spark: SparkSession, d: str) -> DataFrame:
    """Tables of dated ratings in a report: three or more such rows, at most three other lines between them, one of them
    with a rating; all dated lines of their range go, unless less than half of the text were left."""
    lines = reports_of_rows(spark, d)
    low, w = F.lower("line"), F.split(F.trim("line"), " ")
    rated = low.rlike(RATED)
    dated = F.col("line").rlike(r"^\s*(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])(\s|$)")
    figures = F.size(F.filter(F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))), lambda x: x.rlike("^[0-9,.()%+▲▼-]+$")))
    bare = F.col("line").endswith(" -") & (F.size(w) > 2) & (figures <= 1)
    of = Window.partitionBy("o_custkey").orderBy("i")
    told = lines.where(F.trim("line") != "").select("*", dated.alias("dated"), rated.alias("rated")).withColumn("p", F.row_number().over(of))
    hits = told.where(F.col("dated") & (F.col("rated") | bare))
    fresh = F.when(F.col("p") - F.lag("p").over(of) - 1 <= 3, 0).otherwise(1)
    runs = hits.withColumn("run", fresh).withColumn("run", F.sum("run").over(of.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = runs.groupBy("o_custkey", "run").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.count("*").alias("k"), F.bool_or("rated").alias("any")).where("k >= 3 and any")
    ranges = spans.groupBy("o_custkey").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    marked = lines.select("*", dated.alias("dated")).join(ranges, "o_custkey", "left")
    gone = F.col("dated") & F.coalesce(F.exists("ranges", lambda x: (x["a"] <= F.col("i")) & (F.col("i") <= x["b"])), F.lit(False))
    size = lambda c: F.sum(F.when(c, F.length("line") + 1)) - 1
    sums = marked.withColumn("gone", gone).groupBy("o_custkey").agg(F.count("*").alias("n_lines"), F.count_if("gone").alias("dropped"), F.coalesce(size(~F.col("gone")), F.lit(0)).alias("left"), size(F.lit(True)).alias("size"))
    return sums.select("o_custkey", "n_lines", "dropped", (F.col("left") < 0.5 * F.col("size")).alias("reverted"))


@query("""
WITH heads AS (SELECT source, doc_id, string_split(text, chr(10))[1] AS head FROM documents)
SELECT source, md5(head) AS digest, count(*) AS n, min(doc_id) AS kept_on FROM heads GROUP BY source, head HAVING count(*) >= 2
""")
def repeated_header(spark: SparkSession, d: str) -> DataFrame:
    """First lines that documents of a source share; the first occurrence is the one that stays."""
    heads = load(spark, d, "documents").select("source", "doc_id", F.split("text", "\n")[0].alias("head"))
    return heads.groupBy("source", "head").agg(F.count("*").alias("n"), F.min("doc_id").alias("kept_on")).where("n >= 2").select("source", F.md5(F.col("head").cast("binary")).alias("digest"), "n", "kept_on")


@query(r"""
WITH pages AS (SELECT conv_id, text, regexp_matches(text, '^.{0,15}$') AS failed, role FROM conversations),
docs AS (SELECT conv_id, count(*) AS n, sum(length(text)) + 2 * (count(*) - 1) AS chars, sum(len(regexp_extract_all(text, '[\x{E000}-\x{F8FF}\x{FFFD}]'))) AS bad, count(*) FILTER (failed) / count(*) AS failed,
  CASE WHEN count(*) > 2 THEN sum(length(text)) FILTER (role = 'assistant') / sum(length(text)) END AS coverage FROM pages GROUP BY conv_id)
SELECT conv_id, round((0.35 * (1 - least(1, bad / chars * 5)) + 0.25 * least(1, chars / n / 200) + 0.25 * (1 - failed) + coalesce(0.15 * coverage, 0)) / (0.85 + CASE WHEN coverage IS NULL THEN 0 ELSE 0.15 END), 6) AS score FROM docs
""")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    """Quality of an extraction, a conversation with turns for pages: garbled characters, characters a page, failed pages
    and coverage, whose weight goes to the others where it was not measured (here, where there are two turns or less)."""
    n = F.length("text")
    docs = load(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n"), (F.sum(n) + 2 * (F.count("*") - 1)).alias("chars"), F.sum(F.regexp_count("text", F.lit(textfns.GARBLED))).alias("bad"),
        (F.count_if(F.col("text").rlike("^.{0,15}$")) / F.count("*")).alias("failed"), (F.sum(F.when(F.col("role") == "assistant", n)) / F.sum(n)).alias("covered"),
    )
    coverage = F.when(F.col("n") > 2, F.col("covered"))
    score = textfns.weighted(
        (0.35, 1 - F.least(F.lit(1.0), F.col("bad") / F.col("chars") * 5)), (0.25, F.least(F.lit(1.0), F.col("chars") / F.col("n") / 200)), (0.25, 1 - F.col("failed")), (0.15, coverage)
    )
    return docs.select("conv_id", F.round(score, 6).alias("score"))


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS n, list_sort(list(DISTINCT source)) AS sources FROM documents GROUP BY text")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"))


@query("""
WITH items AS (SELECT item_id, list_distinct(list_transform(generate_series(1, len(w) - 7), lambda i: list_aggregate(w[i : i + 7], 'string_agg', ' '))) AS s FROM (SELECT item_id, string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') AS w FROM benchmark)),
docs AS (SELECT doc_id, list_distinct(list_transform(generate_series(1, len(w) - 7), lambda i: list_aggregate(w[i : i + 7], 'string_agg', ' '))) AS s FROM (SELECT doc_id, string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') AS w FROM documents))
SELECT doc_id, item_id, count(*) AS shared FROM (SELECT doc_id, unnest(s) AS x FROM docs) JOIN (SELECT item_id, unnest(s) AS x FROM items) USING (x) GROUP BY 1, 2
""".replace("\\\\", "\\"))
def benchmark_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Runs of eight words that a document shares with a benchmark item."""
    docs, items = load(spark, d, "documents"), load(spark, d, "benchmark")
    return _runs(docs, "doc_id").join(_runs(items, "item_id"), "x").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def _runs(rows: DataFrame, key: str, n: int = 8) -> DataFrame:
    w = F.split(F.regexp_replace(F.lower("text"), r"[\t\n\f\r ]+", " "), " ")
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " "))
    return rows.select(key, w.alias("w")).where(F.size("w") >= n).select(key, F.explode(F.array_distinct(runs)).alias("x"))


@query("SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS local_day, CAST(date_trunc('week', ts) AS DATE) AS week, quarter(ts) AS quarter FROM events")
def local_day(spark: SparkSession, d: str) -> DataFrame:
    local = F.to_date(F.col("ts") + F.expr("interval 8 hours"))
    return load(spark, d, "events").select("event_id", local.alias("local_day"), F.to_date(F.date_trunc("week", "ts")).alias("week"), F.quarter("ts").cast("long").alias("quarter"))


@query("SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket FROM events")
def bucket_5m(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.window("ts", "5 minutes").alias("w")).select("event_id", F.col("w.start").cast("timestamp_ntz").alias("bucket"))


@query("""
SELECT o_orderkey, CAST(date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') AS INTEGER) AS age, round(pow(0.5, greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01')) / 90.0), 9) AS recency,
  CAST(o_orderdate::DATE - INTERVAL 1 MONTH AS DATE) AS month_back FROM orders
""")
def recency_factor(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    age = F.datediff(F.lit("2001-08-01").cast("date"), day)
    return load(spark, d, "orders").select("o_orderkey", age.alias("age"), F.round(F.pow(F.lit(0.5), F.greatest(F.lit(0), age) / 90.0), 9).alias("recency"), F.add_months(day, -1).alias("month_back"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS number, json_extract_string(props, '$.none') AS none FROM events")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return load(spark, d, "events").select("event_id", k.alias("k"), k.try_cast("int").alias("number"), F.get_json_object("props", "$.none").alias("none"))


@query("""
SELECT word, count(*) AS n, list_sort(list(DISTINCT p_brand))[1:3] AS brands FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY word
""")
def explode_array(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "part").select("p_brand", F.explode(F.split("p_type", " ")).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("p_brand")), 1, 3).alias("brands"))


@query("""
WITH told AS (SELECT event_id, props, json_object('Event-' || event_type, value, event_type || '_value', CASE WHEN event_type = 'error' THEN NULL ELSE value END) AS extra FROM events),
pairs AS (SELECT event_id, unnest(json_keys(props)) AS metric, props AS j FROM told UNION ALL SELECT event_id, unnest(json_keys(extra)), extra FROM told)
SELECT event_id, metric, CAST(json_extract(j, '$."' || metric || '"') AS DOUBLE) AS value FROM pairs WHERE regexp_matches(metric, '^[a-z][a-z0-9_.]*$') AND json_type(json_extract(j, '$."' || metric || '"')) <> 'NULL'
""")
def map_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Metrics that events carry as maps, one row each: those with a proper name and a finite value."""
    amount = F.when(F.col("event_type") != "error", F.col("value"))
    extra = F.create_map(F.concat(F.lit("Event-"), "event_type"), F.col("value"), F.concat("event_type", F.lit("_value")), amount)
    rows = load(spark, d, "events").select("event_id", F.from_json("props", "map<string,double>").alias("props"), extra.alias("extra"))
    return tall(rows.select("event_id", F.map_concat("props", "extra").alias("metrics")), "event_id", "metrics")


def tall(rows: DataFrame, key: str, metrics: str) -> DataFrame:
    """key, metric, value of maps of numbers. Names begin with a letter and have lower-case letters, digits, dots and
    underscores; nulls and numbers that are not finite are passed over, each by itself."""
    value = F.col("value")
    named = rows.select(key, F.explode(metrics).alias("metric", "value")).where(F.col("metric").rlike(r"^[a-z][a-z0-9_.]*$"))
    return named.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
