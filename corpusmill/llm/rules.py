"""Quality rules (operator 4): adaptive thresholds from mergeable quantile sketches per language and source.

Five statistics of each text are whole numbers: mean word length (hundredths), marks (code points of words that are no
letters, per thousand), repeated words (per thousand of words), capitals (per thousand of letters) and duplicate lines
(per thousand of lines). A sketch is a histogram with logarithmic bins: the value v falls into bin
floor(ln(1 + v) / ln(GAMMA)), so a quantile read from it is right to a factor of GAMMA, and two sketches merge by adding
their counts, in any order, to the same result. Each group (language, source) has one sketch for each statistic, made
by a grouped count; sketches of groups merge to those of languages, and these to one of all.

A statistic's upper limit is a high quantile plus REACH times its distance from the median; the high quantile is the
third quartile or, where that falls into the median's bin, the first of the quantiles in TAILS that doesn't. Its lower
limit (word length only) is the first quartile less REACH times its distance to the median. They are read from the
group's own sketch if that has LEAST documents and some spread, else from its language's, else from that of all; a
statistic without spread among all bounds nothing. No limit has any other floor or ceiling than the width of a bin.
Documents join their group's limits; one beyond any is dropped.

Only DataFrame functions are used. Null and blank texts have no words and fail the base rules, as do texts of any
length that repeat themselves; long texts are measured whole. Null languages and sources are groups of their own.
Repeated rows count one by one and get a row each; a value equal to a limit is kept. Columns of docs other than doc_id,
lang, source and text, whatever their names, are not read. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, small_or_not, table, words

#: Ratio of neighbouring bin edges.
GAMMA = 1.02
#: Documents that a sketch holds at least, unless it is that of all.
LEAST = 100
#: How many distances from the median to a quantile a limit lies beyond it.
REACH = 14.0
#: Quantiles tried in turn, in hundredths, until one differs from the median.
TAILS = (75, 90, 95, 99)
#: Statistics, and those that are bounded below too.
STATISTICS = ("word_len", "marks", "repeats", "capitals", "dup_lines")
BELOW = ("word_len",)


def base_counts(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_letters> of a text."""
    text = F.coalesce(text, F.lit(""))

    def count(w: Column) -> Column:
        n = F.size(w)
        # windows of three words, sorted, so that equal ones are neighbours: linear in memory, n log n in time
        windows = F.when(n < 3, F.array().cast("array<struct<h:string,i:int>>")).otherwise(
            F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))
        )

        def repeated(s: Column) -> Column:
            m = F.size(s)
            twice = F.filter(s, lambda x, k: ((k > 0) & (x["h"] == F.get(s, k - 1)["h"])) | ((k < m - 1) & (x["h"] == F.get(s, k + 1)["h"])))
            starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
            # each window covers three words from its start, less what the window before it covers
            return F.transform(F.array(starts), lambda p: F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, k - 1)))), F.lit(0), lambda a, x: a + x))[0]

        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.transform(F.array(windows), repeated)[0].cast("long").alias("n_repeat_words"),
        )

    counted = F.transform(F.array(words(text)), count)[0]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        counted["n_words"].alias("n_words"),
        counted["word_chars"].alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        counted["n_repeat_words"].alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit(r"[\p{L}\p{M}]")).cast("long").alias("n_letters"),
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed and the statistics of every row of docs."""
    rows = docs.select("doc_id", "lang", "source", base_counts(F.col("text")).alias("c")).select("doc_id", "lang", "source", "c.*")
    part = lambda a, b, scale: F.when(F.col(b) > 0, F.floor(scale * F.col(a) / F.col(b))).otherwise(F.lit(0)).cast("long")
    return rows.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        part("word_chars", "n_words", 100).alias("word_len"),
        F.when(F.col("word_chars") > 0, F.floor(1000 * (F.col("word_chars") - F.col("n_letters")) / F.col("word_chars"))).otherwise(F.lit(0)).cast("long").alias("marks"),
        part("n_repeat_words", "n_words", 1000).alias("repeats"),
        part("n_capitals", "n_letters", 1000).alias("capitals"),
        part("n_dup_lines", "n_lines", 1000).alias("dup_lines"),
    )


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, name, bin, n: the sketch of each statistic in each group of rows that passed the base rules."""
    tall = rows.where("not base_failed").select("lang", "source", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in STATISTICS]), F.array(*STATISTICS))).alias("name", "value"))
    edge = F.floor(F.log(1.0 + F.col("value")) / F.log(F.lit(GAMMA))).cast("int")
    return tall.select("lang", "source", "name", edge.alias("bin")).groupBy("lang", "source", "name", "bin").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, total and q25, q50 and q of each of TAILS (bins) of the sketches merged over all columns but keys."""
    merged = sketch.groupBy(*keys, "name", "bin").agg(F.sum("n").alias("n"))
    of = Window.partitionBy(*keys, "name")
    upto = merged.withColumn("upto", F.sum("n").over(of.orderBy("bin"))).withColumn("total", F.sum("n").over(of))
    at = [F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bin"))).alias(f"q{q}") for q in (25, 50, *TAILS)]
    return upto.groupBy(*keys, "name").agg(F.first("total").alias("total"), *at)


def limits_of(level: DataFrame, reach: float) -> DataFrame:
    """level (from quantiles) with low and high, the limits that its sketches set; null where they have no spread."""
    value = lambda b: F.pow(F.lit(GAMMA), b) - 1.0
    tail = F.coalesce(*[F.when(F.col(f"q{q}") > F.col("q50"), F.col(f"q{q}")) for q in TAILS])
    high = value(tail + 1) + reach * (value(tail) - value(F.col("q50")))
    low = F.when(F.col("name").isin(*BELOW) & (F.col("q25") < F.col("q50")), value(F.col("q25")) - reach * (value(F.col("q50")) - value(F.col("q25"))))
    return level.withColumn("high", high).withColumn("low", F.when(high.isNotNull(), F.coalesce(low, F.lit(-1.0))))


def thresholds(sketch: DataFrame, least: int = LEAST, reach: float = REACH) -> DataFrame:
    """lang, source and, for each statistic, the lowest and highest value that is kept; null: not bounded."""
    levels = [limits_of(quantiles(sketch, keys), reach) for keys in (["lang", "source"], ["lang"], [])]
    named = lambda df, by: df.select(*[F.col(k).alias(f"{by}_{k}") for k in df.columns])
    own, lang, every = levels[0], named(levels[1], "l"), named(levels[2], "a")
    joined = own.join(lang, own["lang"].eqNullSafe(F.col("l_lang")) & (own["name"] == F.col("l_name"))).join(every, own["name"] == F.col("a_name"))
    enough = lambda by: (F.col(f"{by}total") >= least) & F.col(f"{by}high").isNotNull()
    side = {k: F.when(enough(""), F.col(k)).when(enough("l_"), F.col(f"l_{k}")).otherwise(F.col(f"a_{k}")) for k in ("low", "high")}
    limits = joined.select("lang", "source", "name", *[c.alias(k) for k, c in side.items()])
    pick = lambda name, side: F.max(F.when(F.col("name") == name, F.col(side))).alias(f"{name}_{side}")
    return limits.groupBy("lang", "source").agg(*[pick(k, side) for k in STATISTICS for side in ("low", "high")])


def quality_rules(docs: DataFrame, least: int = LEAST, reach: float = REACH) -> DataFrame:
    """The measured rows of docs (doc_id, lang, source, text) with kept."""
    rows = checkpointed(measured(docs))  # a few numbers for each text; both the sketches and the verdict read them
    limits = thresholds(sketches(rows), least, reach).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"{k}_{s}" for k in STATISTICS for s in ("low", "high")])
    limits = small_or_not(limits)
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    fits = F.lit(True)
    for k in STATISTICS:
        fits = fits & F.coalesce((F.col(k) >= F.col(f"{k}_low")) & (F.col(k) <= F.col(f"{k}_high")), F.lit(True))
    return joined.select(*rows.columns, (~F.col("base_failed") & fits).alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document."""
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _level_sql(keys: str) -> str:
    """Limits of the sketches merged over all columns but keys ("lang, source," or less)."""
    at = ", ".join(f"min(bin) FILTER (upto * 100 >= total * {q}) AS q{q}" for q in (25, 50, *TAILS))
    tail = "coalesce(" + ", ".join(f"CASE WHEN q{q} > q50 THEN q{q} END" for q in TAILS) + ")"
    value = lambda b: f"(pow({GAMMA}::DOUBLE, {b}) - 1)"
    below = ", ".join(f"'{k}'" for k in BELOW)
    return f"""(SELECT {keys} name, total, high, CASE WHEN high IS NOT NULL THEN coalesce(low, -1) END AS low FROM (
  SELECT *, {value("tail + 1")} + {REACH} * ({value("tail")} - {value("q50")}) AS high,
    CASE WHEN name IN ({below}) AND q25 < q50 THEN {value("q25")} - {REACH} * ({value("q50")} - {value("q25")}) END AS low FROM (
    SELECT *, {tail} AS tail FROM (SELECT {keys} name, any_value(total) AS total, {at} FROM (
      SELECT {keys} name, bin, sum(n) OVER (PARTITION BY {keys} name ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {keys} name) AS total
      FROM (SELECT {keys} name, bin, sum(n) AS n FROM sketches GROUP BY {keys} name, bin)) GROUP BY {keys} name))))"""


_FITS = " AND ".join(f"coalesce(m.{k} >= l.{k}_low AND m.{k} <= l.{k}_high, true)" for k in STATISTICS)
_PICK = ", ".join(f"max({s}) FILTER (name = '{k}') AS {k}_{s}" for k in STATISTICS for s in ("low", "high"))
_CHOSEN = ", ".join(
    f"CASE WHEN o.total >= {LEAST} AND o.high IS NOT NULL THEN o.{s} WHEN l.total >= {LEAST} AND l.high IS NOT NULL THEN l.{s} ELSE a.{s} END AS {s}" for s in ("low", "high")
)
OP4_SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM (
    SELECT r, unnest(generate_series(1, len(w) - 2)) AS i, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS win FROM texts WHERE len(w) >= 3)
), repeats AS (
  SELECT r, sum(least(3, coalesce(i - before, 3))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM windows WHERE n > 1) GROUP BY r
), counts AS (
  SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(e.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(t, '[\p{{L}}\p{{M}}]')) AS n_letters
  FROM texts t LEFT JOIN repeats e ON e.r = t.r
), measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN n_words > 0 THEN floor(100 * word_chars / n_words) ELSE 0 END AS word_len,
    CASE WHEN word_chars > 0 THEN floor(1000 * (word_chars - n_letters) / word_chars) ELSE 0 END AS marks, CASE WHEN n_lines > 0 THEN floor(1000 * n_dup_lines / n_lines) ELSE 0 END AS dup_lines,
    CASE WHEN n_words > 0 THEN floor(1000 * n_repeat_words / n_words) ELSE 0 END AS repeats, CASE WHEN n_letters > 0 THEN floor(1000 * n_capitals / n_letters) ELSE 0 END AS capitals FROM counts
), sketches AS (
  SELECT lang, source, name, CAST(floor(ln(1.0::DOUBLE + v) / ln({GAMMA}::DOUBLE)) AS INTEGER) AS bin, count(*) AS n FROM (
    SELECT lang, source, unnest([{", ".join(f"'{k}'" for k in STATISTICS)}]) AS name, unnest([{", ".join(STATISTICS)}]) AS v FROM measured WHERE NOT base_failed) GROUP BY ALL
), chosen AS (
  SELECT o.lang, o.source, o.name, {_CHOSEN}
  FROM {_level_sql("lang, source,")} o JOIN {_level_sql("lang,")} l ON l.lang IS NOT DISTINCT FROM o.lang AND l.name = o.name JOIN {_level_sql("")} a ON a.name = o.name
), limits AS (
  SELECT lang, source, {_PICK} FROM chosen GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_FITS} AS kept
FROM measured m LEFT JOIN limits l ON l.lang IS NOT DISTINCT FROM m.lang AND l.source IS NOT DISTINCT FROM m.source
"""
