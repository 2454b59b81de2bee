"""Quality classifier (operator 1): a sparse rule ensemble over text statistics.

Spark computes a dozen statistics of every text. On a bounded sample of labelled rows, small trees are grown on random
halves of the rows and of the statistics; every path from a root to a node is a rule, a conjunction of comparisons.
Lasso logistic regression over all rules leaves few of them with a weight. These are compiled into one Spark column
expression, which scores all documents inside the JVM.

Only text is looked at: never labels, lang, source or doc_id of the row scored. Null texts count as empty, all of whose
statistics are 0, and get a score like any other; long texts are measured whole. Repeated rows score alike, whatever
columns they have besides doc_id and text. A doc_id with both labels counts as good; of splits that are as good as each
other the first is taken. Without labels of both classes, every score is near the one that exists, and 0.5 if there is
none, as for empty tables, which give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_sample, table, words

#: Labelled rows that the fit takes at most, about.
SAMPLE = 16_000
#: Trees, their depth, the rows a node keeps at least, candidate thresholds of a statistic.
TREES, DEPTH, LEAF, CUTS = 30, 3, 12, 24
#: Strength of the lasso, on the mean log-loss, and its steps.
LASSO, STEPS = 1.5e-3, 300
STATISTICS = (
    "n_words", "word_len", "capitals", "symbols", "exclaims", "digits", "stops", "pipes", "echoes", "variety", "dup_lines", "line_words"
)


def statistics(text: Column) -> Column:
    """struct of STATISTICS, doubles, of a text: logarithm of its words, code points in a word, capitals among letters,
    marks per word, words equal to the word before, distinct words, lines equal to another line, words in a line."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n"),
            F.length(F.array_join(w, "")).alias("chars"),
            F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))).alias("echoes"),
            F.size(F.array_distinct(w)).alias("kinds"),
        )

    w = F.transform(F.array(words(text)), of_words)[0]
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    raw = F.struct(
        w.alias("w"),
        count(r"\p{Lu}").alias("capitals"), count(r"\p{L}").alias("letters"), count(r"[#*$%&<>]").alias("symbols"), count("!").alias("exclaims"),
        count(r"\p{Nd}").alias("digits"), count(r"[.?]").alias("stops"), count(r"\|").alias("pipes"),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds")))[0].alias("l"),
    )

    def shares(r: Column) -> Column:
        n, lines = r["w"]["n"], r["l"]["n"]
        part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        return F.struct(
            F.log1p(n.cast("double")).alias("n_words"), part(r["w"]["chars"], n).alias("word_len"), part(r["capitals"], r["letters"]).alias("capitals"),
            part(r["symbols"], n).alias("symbols"), part(r["exclaims"], n).alias("exclaims"), part(r["digits"], n).alias("digits"),
            part(r["stops"], n).alias("stops"), part(r["pipes"], n).alias("pipes"), part(r["w"]["echoes"], n).alias("echoes"),
            part(r["w"]["kinds"], n).alias("variety"), part(lines - r["l"]["kinds"], lines).alias("dup_lines"), part(n, lines).alias("line_words"),
        )

    return F.transform(F.array(raw), shares)[0]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether above, threshold), its weight in the score."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self, stats: Column) -> Column:
        holds = F.lit(True)
        for name, above, cut in self.terms:
            holds = holds & ((stats[name] > cut) if above else (stats[name] <= cut))
        return F.when(holds, F.lit(self.weight)).otherwise(F.lit(0.0))


def _split(x: np.ndarray, y: np.ndarray, names: np.ndarray) -> tuple[int, float] | None:
    """The statistic and threshold that lower the Gini impurity of y most."""
    best, found = y.sum() * (1 - y.mean()) - 1e-9, None
    for j in names:
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, CUTS)))
        low = x[:, j][:, None] <= cuts
        n = low.sum(axis=0)
        ones = (low * y[:, None]).sum(axis=0)
        m, rest = len(y) - n, y.sum() - ones
        with np.errstate(all="ignore"):
            impurity = np.where((n < LEAF) | (m < LEAF), np.inf, ones * (1 - ones / n) + rest * (1 - rest / m))
        if len(cuts) and impurity.min() < best:
            best, found = impurity.min(), (int(j), float(cuts[impurity.argmin()]))
    return found


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[tuple[tuple[str, bool, float], ...]]:
    """The paths of all trees, each once."""
    rng = np.random.default_rng(seed)
    rules: dict[tuple[tuple[str, bool, float], ...], None] = {}
    for _ in range(TREES):
        todo = [(rng.random(len(y)) < min(0.5, 4000 / max(1, len(y))) if len(y) > 400 else np.ones(len(y), bool), ())]
        while todo:
            rows, path = todo.pop()
            if path:
                rules[path] = None
            own = y[rows]
            if len(path) == DEPTH or len(own) < 2 * LEAF or own.min() == own.max():
                continue
            if (at := _split(x[rows], own, rng.permutation(len(STATISTICS))[: 1 + len(STATISTICS) // 2])) is not None:
                j, cut = at
                below = x[:, j] <= cut
                todo += [(rows & below, (*path, (STATISTICS[j], False, cut))), (rows & ~below, (*path, (STATISTICS[j], True, cut)))]
    return list(rules)


def lasso(z: np.ndarray, y: np.ndarray, strength: float = LASSO, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of logistic regression on the 0/1 columns of z under an L1 penalty, by accelerated
    proximal gradient steps."""
    mean, scale = z.mean(axis=0), z.std(axis=0) + 1e-6
    x = ((z - mean) / scale).astype(np.float32)
    rate = 4.0 * len(y) / max(np.linalg.norm(x.T @ x, 2), 1e-9) if x.shape[1] else 1.0
    rate = min(rate, 4.0)
    w = v = np.zeros(x.shape[1], np.float32)
    b, t = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(x @ v + b))) - y
        new = v - rate * (x.T @ error) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * strength, 0)
        b -= min(rate * 4, 1.0) * float(error.mean())
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = (new + (t - 1) / nt * (new - w)).astype(np.float32)
        w, t = new, nt
    weights = w / scale
    return weights, b - float(weights @ mean)


def fit(rows: DataFrame) -> tuple[list[Rule], float]:
    """Rules with a weight and the intercept, from rows (text, label) that labelled_sample has bounded. Their statistics
    are all that reaches the driver."""
    got = rows.select("label", statistics(F.col("text")).alias("s")).select("label", "s.*").toPandas()
    y = got["label"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return [], 0.0 if not len(y) else (12.0 if y[0] else -12.0)
    got = got.sort_values([*STATISTICS, "label"], kind="stable")  # the same fit in whatever order rows arrive
    y, x = got["label"].to_numpy(np.float64), got[list(STATISTICS)].to_numpy(np.float64)
    paths = tree_rules(x, y)
    if not paths:
        return [], math.log(y.mean() / (1 - y.mean()))
    at = {name: j for j, name in enumerate(STATISTICS)}
    z = np.stack([np.logical_and.reduce([(x[:, at[n]] > c) == above for n, above, c in p]) for p in paths], axis=1).astype(np.float32)
    weights, intercept = lasso(z, y)
    return [Rule(p, float(w)) for p, w in zip(paths, weights) if abs(w) > 1e-4], float(intercept)


def score(text: Column, model: tuple[list[Rule], float]) -> Column:
    """The compiled score of a text, 0 to 1."""
    rules, intercept = model

    def weigh(stats: Column) -> Column:
        total = F.lit(intercept)
        for rule in rules:
            total = total + rule.column(stats)
        return 1.0 / (1.0 + F.exp(-total))

    return F.transform(F.array(statistics(text)), weigh)[0]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows with crc32(doc_id) mod 3 = 1 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = fold(F.col("doc_id"), 3)
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", part != 1, SAMPLE))
    out = docs.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
