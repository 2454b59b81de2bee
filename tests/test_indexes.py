"""Term and vector indexes against plain scans; tables that are derived once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import retrieval
from corpusmill.sources import stored, termindex, vectorindex

TEXTS = ["the cat in the hat", "100% sure_thing a\\b", "日本語テキスト", "本", "", None, "a\x00b", "ab" * 300, "the", "in the", "x", "😀 smile 😀"]
KEYS = ["doc_id", "chunk_index"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(i, 0, t) for i, t in enumerate(TEXTS)] + [(100 + i, i % 3, f"row {i} of the hat" + " word" * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index int, content string")
    path = str(tmp_path_factory.mktemp("terms") / "index")
    termindex.write_index(df, KEYS, "content", path)
    return termindex.TermIndex(spark, path, KEYS), rows


TERMS = [["the"], ["the", "hat"], ["in"], ["100%"], ["e_t"], ["a\\b"], ["日本"], ["語テキ"], ["本"], ["x"], ["😀"], ["😀 s"], ["abab", "ba"], ["row 7 "], ["nowhere"], [], ["the", "o", "word"]]


@pytest.mark.parametrize("named", [500, 0])
@pytest.mark.parametrize("terms", TERMS, ids=repr)
def test_terms_are_found_as_a_scan_finds_them(index, monkeypatch, terms, named):
    monkeypatch.setattr(termindex, "NAMED", named)
    ix, rows = index
    got = sorted((r["doc_id"], r["chunk_index"]) for r in ix.search(terms).collect())
    assert got == sorted((i, k) for i, k, t in rows if all(x in (t or "") for x in terms))


def test_cap_and_one_a_report_repeat_themselves(index):
    ix, rows = index
    got = ix.search(["hat"], where=F.col("doc_id") > 150, cap=40, per="chunk_index", by=[F.desc("doc_id")]).collect()
    hits = sorted((i, k) for i, k, t in rows if "hat" in (t or "") and i > 150)[:40]
    assert sorted((r["chunk_index"], r["doc_id"]) for r in got) == [(k, max(i for i, c in hits if c == k)) for k in range(3)]


def test_lists_leave_only_segments_with_holders(spark, tmp_path, monkeypatch):
    """What the lists exclude is not read: a rare term leaves as many candidates as it has holders."""
    monkeypatch.setattr(termindex, "SEGMENT", 20)
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.concat(F.lit("common words "), F.when(F.col("id") == 77, "zebra").otherwise("horse")).alias("content"))
    termindex.write_index(df, KEYS, "content", str(tmp_path / "i"))
    ix = termindex.TermIndex(spark, str(tmp_path / "i"), KEYS)
    assert ix.candidates(termindex.grams_of("zebra")).count() == 1
    assert ix.holders(termindex.grams_of("zebra")).count() == 1 and ix.holders(termindex.grams_of("common")).count() > 10
    longest = ix.postings.agg(F.max(F.size("numbers"))).first()[0]
    assert longest < 60  # a list is a segment's, however many chunks hold the gram


def vectors(spark, n, dim=8, seed=1, clusters=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * (0.2 if clusters else 1) + (rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] if clusters else 0)
    v[n // 2 : n // 2 + n // 4] = v[0]  # a quarter of all are copies
    v[n - 1] = 0
    return v, spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(None, [1.0] * dim, 0), (n, None, 0)], "vec_id long, embedding array<double>, label int")


def brute(v, probes, k, within=2.0, keep=lambda i: True, own=lambda i: i):
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    out = []
    for p in probes:
        far = np.round(1 - u @ u[p], 9)
        best = sorted((float(far[i]), i) for i in range(len(v)) if keep(i) and own(i) != own(p) and far[i] <= within)[:k]
        out += [(p, i, d, n + 1) for n, (d, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("part, probes", [(1 << 14, 2048), (20, 3)])
def test_exact_neighbours(spark, tmp_path, monkeypatch, part, probes):
    """Copies fill one cell, which is searched in parts."""
    monkeypatch.setattr(vectorindex, "PART", part)
    monkeypatch.setattr(vectorindex, "PROBES", probes)
    v, df = vectors(spark, 300)
    vectorindex.write_index(df, str(tmp_path / "v"))
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("probe"), "embedding")
    ids = range(0, 300, 20)
    ix = vectorindex.VectorIndex(spark, str(tmp_path / "v"))
    same = lambda rows, want: [(a, b, n) for a, b, _, n in sorted(map(tuple, rows))] == [(a, b, n) for a, b, _, n in want]
    assert same(ix.nearest(asked, 7, first=2).collect(), brute(v, ids, 7))
    assert same(ix.nearest(asked, 7, within=0.3, first=3).collect(), brute(v, ids, 7, 0.3))
    few = vectorindex.VectorIndex(spark, str(tmp_path / "v"), F.col("label") != 1)
    assert same(few.nearest(asked, 5, first=2).collect(), brute(v, ids, 5, keep=lambda i: i % 3 != 1))
    grouped = ix.nearest(asked.withColumn("own", F.expr("probe div 10")), 5, first=2, apart=F.expr("vec_id div 10"))
    assert same(grouped.collect(), brute(v, ids, 5, own=lambda i: i // 10))


@pytest.mark.parametrize("clusters", [0, 25])
def test_cells_alone_reach_the_recall_that_a_sample_of_probes_asks_for(spark, tmp_path, clusters):
    v, df = vectors(spark, 2000, 16, 3, clusters)
    vectorindex.write_index(df, str(tmp_path / "v"))
    ix = vectorindex.VectorIndex(spark, str(tmp_path / "v"))
    probe = lambda m, r: df.where(f"vec_id % {m} = {r}").select(F.col("vec_id").alias("probe"), "embedding")
    first = ix.cells_for(probe(97, 5), 10)
    want = {(a, b) for a, b, _, _ in brute(v, range(0, 2000, 20), 10)}
    got = {(r["probe"], r["vec_id"]) for r in ix.nearest(probe(20, 0), 10, first=first, exact=False).collect()}
    assert len(want & got) / len(want) >= 0.9
    if clusters:
        assert first < len(ix.ids) / 2  # and leaves most cells alone


def test_an_index_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    vectorindex.write_index(df, str(tmp_path / "v"))
    ix = vectorindex.VectorIndex(spark, str(tmp_path / "v"))
    assert ix.nearest(spark.createDataFrame([(1, [1.0])], "probe long, embedding array<double>"), 3).count() == 0
    termindex.write_index(spark.createDataFrame([], "doc_id long, chunk_index int, content string"), KEYS, "content", str(tmp_path / "t"))
    assert termindex.TermIndex(spark, str(tmp_path / "t"), KEYS).search(["abc"]).count() == 0


def test_spaced_rows(spark):
    rows = spark.createDataFrame([(g, i) for g, n in ((1, 1), (2, 11), (3, 12), (4, 13), (5, 100)) for i in range(n)], "g int, i int")
    got = {}
    for r in retrieval.spaced(rows, "g", "i").collect():
        got.setdefault(r["g"], set()).add(r["i"])
    assert got == {g: {k * n // min(n, 12) for k in range(min(n, 12))} for g, n in ((1, 1), (2, 11), (3, 12), (4, 13), (5, 100))}


def test_a_single_term_is_no_match_of_all_terms(spark):
    rows = spark.createDataFrame([(False, 1), (True, 1), (False, 0)], "phrase boolean, hits int")
    tier = lambda n: [tuple(r) for r in rows.select(*retrieval.tier_and_bonus(F.col("phrase"), F.col("hits"), n)).collect()]
    assert tier(1) == [(0, 0.05), (2, 0.25), (0, 0.0)] and tier(2)[0] == (0, 0.025)


def test_tables_are_derived_once_and_anew_when_their_source_changes(spark, tmp_path):
    source, built = f"{tmp_path}/source", []

    def build(path):
        built.append(path)
        spark.read.parquet(source).write.parquet(path)

    spark.range(3).write.parquet(source)
    paths = [stored.derived(spark, "copy", source, build, str(tmp_path)) for _ in range(2)]
    assert paths[0] == paths[1] and len(built) == 1 and spark.read.parquet(paths[0]).count() == 3
    spark.range(5).write.mode("append").parquet(source)
    assert stored.derived(spark, "copy", source, build, str(tmp_path)) != paths[0] and len(built) == 2
    with pytest.raises(ZeroDivisionError):
        stored.derived(spark, "broken", source, lambda path: 1 // 0, str(tmp_path))
    assert not list(tmp_path.glob("broken*"))


def test_a_table_is_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/t"
    stored.replace_table(spark.range(3), path)
    with pytest.raises(Exception, match="division|DIVIDE"):
        stored.replace_table(spark.range(5).select((F.lit(1) / F.raise_error(F.lit("division"))).alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    stored.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_texts_are_not_shuffled(spark, tmp_path):
    """Neither to be indexed nor to be found, by a term that all segments hold: texts stay in their task."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.concat(F.lit("common words "), F.sha2(F.col("id").cast("string"), 512)).alias("content"))

    def shuffled():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    termindex.write_index(df, KEYS, "content", str(tmp_path / "i"))
    assert shuffled() - before < 1000
    found = termindex.TermIndex(spark, str(tmp_path / "i"), KEYS).search(["common"])
    found.write.format("noop").mode("overwrite").save()
    assert shuffled() - before < 500_000 and found.count() == 20_000  # the texts have 2.8 MB, their lists 0.2


@pytest.mark.parametrize("sent", [0, 10_000])
def test_segments_of_two_tasks_and_lists_too_many_to_send(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(termindex, "SEGMENT", 64)
    df = spark.range(0, 1000, 1, 3).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(" end")).alias("content"))
    termindex.write_index(df, KEYS, "content", str(tmp_path / "i"))
    ix = termindex.TermIndex(spark, str(tmp_path / "i"), KEYS)
    spread = ix.postings.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("numbers", F.expr("filter(numbers, n -> n % 2 = half)")).where("size(numbers) > 0")
    ix.postings = spread.drop("half")  # as if each segment lay in two tasks
    monkeypatch.setattr(termindex, "NAMED", 0)
    monkeypatch.setattr(termindex, "SENT", sent)
    assert sorted(r["doc_id"] for r in ix.search(["12", "end"]).collect()) == [i for i in range(1000) if "12" in str(i)]
