"""Toxicity (operator 5): a weighted lexicon matched by Aho-Corasick.

A text is folded first: look-alike letters of other scripts, either case, to Latin ones; compatibility forms (full
width, mathematical) to plain letters; marks and invisible characters dropped; lower case; digits and signs that stand
for letters to these; letters spelled out one by one put together; everything else than letters to one space. An
automaton then finds, in one pass, all entries: words and beginnings of words with a weight, and exception phrases,
inside which entries don't count. A word counts once, by its heaviest entry. The sum of weights, its density in the
text, and the heaviest entry, each damped, are normalised by length and turned into a score by logistic weights.

Entries and weights are learned from a bounded sample of labelled rows, with a short list of insults to begin with:
an entry's weight is the logarithm of its odds to occur in toxic against clean documents, and it is kept if its
log-likelihood ratio is more than the best of all candidates would reach by chance. Candidates are counted, tested and
selected by Spark; those that fewer than two, or one in 400, of the sample's toxic documents hold are not tested (`least`
in `lexicon`): a bound on the entries by the documented sample, not on the texts that are scored. The logistic weights are fit on features that leave out each row's own
quarter of the sample, by a digest of the text, so that rare entries are not overrated and copies stay together. The
same functions find entries and make features in the fit and in scoring.

Only text is looked at. Null, blank and letterless texts have no word and the score of a text without entries; texts
of any length are read whole. Repeated rows score alike; of entries of equal weight at one word the last in code point
order is reported. Without labels of both classes, or with empty tables, the given list decides. Extra columns are not
read. What reaches the driver is the entries that pass the test and six numbers for each row of the sample.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fold, labelled_sample, small_batches, table, text_udf

#: Labelled rows that the fit takes at most, about.
SAMPLE = 16_000
#: Parts of the sample, each scored with entries weighed on the others.
PARTS = 4
#: Lengths of word beginnings that may become entries.
PREFIXES = range(3, 10)
#: Weight of a given entry that the sample does not know, and the least weight of a learned one.
GIVEN, LEAST = 3.0, 1.0
#: Counts that a task holds before it hands them on.
HELD = 200_000

# Insults to begin with, and phrases in which such words are harmless.
LEXICON = (
    "idiot moron stupid dumb imbecile cretin fool loser scum trash garbage worthless pathetic disgusting clown jerk bastard bitch asshole fuck "
    "shit crap whore slut pig vermin filth filthy retard dimwit halfwit dunce nitwit scumbag dirtbag lowlife degenerate subhuman parasite"
).split()
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "garbage can", "garbage collection", "garbage collector", "clown fish", "pond scum", "guinea pig", "pig iron")
# Letters that look like Latin ones (Cyrillic, Greek, others), and digits and signs that stand for letters.
LOOKS = str.maketrans(
    "аеорсухіјѕԁԛԝһӏткмнвАЕОРСУХІЈЅԀԚԜҺӀТКМНВ" + "αορνικτυχεηωβΑΟΡΝΙΚΤΥΧΕΗΒΖΜ" + "ıɡɑøØłŁđĐħĦ",
    "aeopcyxijsdqwhltkmhbaeopcyxijsdqwhltkmhb" + "aopviktuxenwbaopniktyxehbzm" + "igaoollddhh",
)
SIGNS = str.maketrans("0134578@$!|€", "oieastbasile")
SIGN = re.compile(r"[0134578@$!|€]+(?=[^\W\d_])")
LETTERS = re.compile(r"[^\W\d_]+")
#: Three or more single letters in a row, each between single spaces.
SPELLED = re.compile(r"(?<= )(?:\w ){2,}\w(?= )")


def folded(text: str) -> str:
    """The words of a folded text, each between single spaces."""
    if not text.isascii():
        plain = unicodedata.normalize("NFKD", text.translate(LOOKS)).translate(LOOKS)
        text = "".join(c for c in plain if c.isascii() or unicodedata.category(c) not in ("Mn", "Me", "Cf"))
    found = LETTERS.findall(SIGN.sub(lambda m: m[0].translate(SIGNS), text.lower()))
    return SPELLED.sub(lambda m: m[0].replace(" ", ""), f" {' '.join(found)} ") if found else ""


def automaton(entries: dict[str, object]) -> ahocorasick.Automaton:
    """Matches entries, which begin with a space, and exception phrases between spaces (no entry)."""
    found = ahocorasick.Automaton()
    for entry in entries:
        found.add_word(entry, (len(entry), entry))
    for phrase in EXCEPTIONS:
        found.add_word(f" {phrase} ", (len(phrase) + 2, None))
    found.make_automaton()
    return found


def matches(text: str, entries: ahocorasick.Automaton, weights: dict[str, float]) -> list[tuple[str, float]]:
    """The heaviest entry of each word of a folded text that has one, but for words in an exception phrase."""
    best: dict[int, tuple[float, str]] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, entry) in entries.iter(text):
        start = end - length + 1
        if entry is None:
            spared.append((start, end))
        elif (weight := weights.get(entry, 0.0)) > 0 and (start not in best or (weight, entry) > best[start]):
            best[start] = (weight, entry)
    for a, b in spared:
        for start in range(a, b) if b - a < len(best) else list(best):
            if a <= start < b:
                best.pop(start, None)
    return [(entry, weight) for weight, entry in best.values()]


def features(hits: list[tuple[str, float]], n_words: int) -> list[float]:
    """What the logistic weights go with: sum, density and maximum of weights, damped; length."""
    weights = [w for _, w in hits]
    total = sum(weights)
    return [1.0, np.log1p(total), np.log1p(100.0 * total / max(1, n_words)), max(weights, default=0.0), np.log1p(n_words), np.log1p(len(weights))]


def described(text: str | None, entries: ahocorasick.Automaton, weights: dict[str, float]) -> tuple[list[float], list[str]]:
    """The features of a text and the entries that counted."""
    words = folded(text or "")
    hits = matches(words, entries, weights)
    return features(hits, max(0, words.count(" ") - 1)), [e.strip() for e, _ in hits]


def candidates(rows: DataFrame) -> DataFrame:
    """entry and, for each label and part, in how many texts of rows (text, label, part) it occurs: toxic0 .. clean3."""

    def batch_of(sums: Counter[tuple[str, int, int]]) -> pa.RecordBatch:
        keys = list(sums)
        columns = {"entry": pa.array([k[0] for k in keys], pa.string()), "label": pa.array([k[1] for k in keys], pa.int32()), "part": pa.array([k[2] for k in keys], pa.int32())}
        return pa.RecordBatch.from_pydict(columns | {"n": pa.array(sums.values(), pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[tuple[str, int, int]] = Counter()
        for batch in batches:
            for text, label, part in zip(*(batch[k].to_pylist() for k in ("text", "label", "part"))):
                found = set()
                for word in set(folded(text).split()):
                    found.update(f" {word[:k]}" for k in PREFIXES if k <= len(word))
                    found.add(f" {word} ")
                sums.update((x, label, part) for x in found)
                if len(sums) > HELD:
                    yield batch_of(sums)
                    sums.clear()
        yield batch_of(sums)

    small_batches()
    tall = rows.select("text", "label", "part").mapInArrow(count, "entry string, label int, part int, n long")
    of = lambda label, part: F.sum(F.when((F.col("label") == label) & (F.col("part") == part), F.col("n")).otherwise(0))
    return tall.groupBy("entry").agg(*[of(y, k).alias(f"{name}{k}") for y, name in ((1, "toxic"), (0, "clean")) for k in range(PARTS)])


def log_odds(toxic: Column, clean: Column, n_toxic: Column, n_clean: Column, kinds: int) -> Column:
    """Logarithm of the odds of an entry to occur in toxic against clean texts; 0 for one whose log-likelihood ratio is
    no more than the best of so many kinds of entries would reach by chance."""
    odds = F.log((toxic + 0.3) / (n_toxic - toxic + 1.0)) - F.log((clean + 0.5) / (n_clean - clean + 1.0))
    even = (toxic + clean) / (n_toxic + n_clean)
    term = lambda n, of: F.when((n > 0) & (of > 0), n * F.log(n / (even * of))).otherwise(0.0)
    return F.when((odds > 0) & (2 * (term(toxic, n_toxic) + term(clean, n_clean)) > float(2 * np.log(max(kinds, 100)))), odds).otherwise(0.0)


def _logistic(x: np.ndarray, y: np.ndarray, usual: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights that stay near the usual ones unless the rows tell otherwise: Newton steps, each halved until the
    penalised log-loss, which is convex, falls."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * ((w - usual) ** 2).sum())

    w = usual.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - usual)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        now, size = loss(w), 1.0
        while size > 1e-8 and loss(w - size * step) > now - 1e-4 * size * (grad @ step):
            size /= 2
        if size <= 1e-8 or np.abs(step).max() < 1e-8:
            break
        w = w - size * step
    return w


def lexicon(rows: DataFrame, sizes: dict[tuple[int, int], int]) -> list[dict[str, float]]:
    """Weights of entries: learned from all of rows (text, label, part), then from all parts but each. sizes: how many
    rows of each label and part there are."""
    counts = checkpointed(candidates(rows))
    known = [[sum(n for (y, k), n in sizes.items() if y == label and k != left) for label in (1, 0)] for left in (None, *range(PARTS))]
    least = max(2, known[0][0] // 400)
    add = lambda name: F.aggregate(F.array(*[f"{name}{k}" for k in range(PARTS)]), F.lit(0).cast("long"), lambda a, x: a + x)
    summed = counts.select("entry", add("toxic").alias("toxic"), add("clean").alias("clean"), F.array(*[f"toxic{k}" for k in range(PARTS)]).alias("t"), F.array(*[f"clean{k}" for k in range(PARTS)]).alias("c"))
    kinds = summed.where(F.col("toxic") >= least).count()
    given = [f" {w}" for w in LEXICON]
    # one row for each entry and model: 0 learns from all parts, k from all but part k - 1
    models = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("n_toxic"), F.lit(c).alias("n_clean")) for k, (t, c) in enumerate(known)])
    tall = summed.where((F.col("toxic") >= least) | F.col("entry").isin(*given)).select("*", F.explode(models).alias("m"))
    without = lambda all_, parts: F.when(F.col("m.k") == 0, F.col(all_)).otherwise(F.col(all_) - F.get(parts, F.col("m.k") - 1))
    tall = tall.select("entry", F.col("toxic").alias("every"), "m.*", without("toxic", "t").alias("toxic"), without("clean", "c").alias("clean"))
    tall = tall.withColumn("w", log_odds(F.col("toxic"), F.col("clean"), F.col("n_toxic"), F.col("n_clean"), kinds))
    learned = F.when((F.col("every") >= least) & (F.col("w") >= LEAST), F.col("w")).otherwise(0.0)
    base = F.when(F.col("entry").isin(*given), F.lit(GIVEN)).otherwise(0.0)
    weight = F.when(F.col("clean") > F.col("toxic"), learned).otherwise(F.greatest(base, learned))  # a given entry stays, unless clean texts hold it
    got = tall.select("entry", "k", weight.alias("w"), F.col("entry").isin(*given).alias("given")).where("w > 0 or given").collect()
    out = [dict.fromkeys(given, GIVEN) for _ in known]
    for row in got:
        out[row["k"]][row["entry"]] = row["w"]
    return [{e: v for e, v in sorted(at.items()) if v > 0} for at in out]


def fit(sample: DataFrame, spark: SparkSession) -> tuple[dict[str, float], list[float]]:
    """Weights of the entries and of the features, from rows (doc_id, text, label) that labelled_sample has bounded."""
    usual = [-3.0, 1.0, 0.5, 0.5, 0.0, 0.0]
    rows = checkpointed(sample.select("text", "label", F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(PARTS)).cast("int").alias("part")))
    sizes = {(r["label"], r["part"]): r["count"] for r in rows.groupBy("label", "part").count().collect()}
    if len({y for y, _ in sizes}) < 2:
        return {f" {w}": GIVEN for w in LEXICON}, usual
    final, *others = lexicon(rows, sizes)
    shared = spark.sparkContext.broadcast(others)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(dict.fromkeys(chain.from_iterable(shared.value)))
        for batch in batches:
            x = [described(t, found, shared.value[k])[0] for t, k in zip(batch["text"].to_pylist(), batch["part"].to_pylist())]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "label": batch["label"]})

    got = rows.mapInArrow(measure, "x array<double>, label int").toPandas()
    x, y = np.array(got["x"].tolist(), float), got["label"].to_numpy(float)
    order = np.lexsort((y, *x.T))  # the same sums in whatever order rows arrive
    return final, _logistic(x[order], y[order], np.array(usual)).tolist()


def toxicity(text: Column, model: tuple[dict[str, float], list[float]], spark: SparkSession) -> Column:
    """struct<score, matches> of each text: 0 to 1, and the entries that counted. The lexicon, as large as the
    bounded sample made it, is broadcast; each worker builds the automaton once."""
    shared = spark.sparkContext.broadcast(model)

    @text_udf("score double, matches array<string>")
    def score_toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, head = shared.value
        entries, head = automaton(weights), np.array(head)
        for texts in batches:
            told = [described(t, entries, weights) for t in texts.to_pylist()]
            x, found = [f for f, _ in told], [e for _, e in told]
            scores = 1 / (1 + np.exp(-np.clip(np.array(x).reshape(-1, len(head)) @ head, -30, 30)))
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))], ["score", "matches"])

    return score_toxicity(text)


def learn(spark: SparkSession, sf_dir: str, docs: DataFrame) -> tuple[dict[str, float], list[float]]:
    """The model from labelled rows of docs (doc_id, text) whose crc32(doc_id) mod 5 is not 0."""
    return fit(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", fold(F.col("doc_id"), 5) != 0, SAMPLE), spark)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows with crc32(doc_id) mod 5 = 0 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(spark, sf_dir, docs)
    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), toxicity(F.col("text"), model, spark)["score"].alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
