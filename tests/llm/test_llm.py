"""The training-data operators against brute force, libraries and planted cases."""

import hashlib
import importlib
import json
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import corpus_pipeline
from corpusmill.llm import bpe, common, langid, likeness, merkle, mixing, periodic, pieces, quality, queries, rules, simhash, stars, tokencount, toxicity, turntrie, webtext

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CONVERSATIONS = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " ", "\n\n", "a", "the the the", "don't  stop 'll 're x", "日本語 テキスト １２３", "🤖 a\x00b\x1cc", "x" * 3000, "ab " * 4000,
    "<|endoftext|>a<|endoftext|>", " wide　space ", "I'D I'd 'S", "éé ½²ⅷ", "line\nline\nline\n",
]


def odd_docs(spark, extra=""):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(ODD)]
    rows += [rows[5], (None, "no id", None, None, 5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *extra.split(";")) if extra else df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def tables_dir(spark, tmp_path_factory):
    """Tables whose documents are odd: nulls, repeats, clashing extra columns."""
    root = tmp_path_factory.mktemp("odd")
    clashing = "1 AS n_words;2 AS size;'x' AS score;3 AS fp;4 AS bin;5 AS label;'k' AS key;6 AS target;7 AS root"
    odd_docs(spark, clashing).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, None, 1), (2, 0, None), (4, 1, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "u", None), (2, None, "<p>a"), (2, None, "<p>a")], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    turns = [(100, None, "user", None), (100, 1, None, "b"), (100, 1, None, "b"), (101, 0, "user", "x"), (None, 0, "user", "x")]
    spark.createDataFrame(turns, CONVERSATIONS).selectExpr("*", "1 AS block", "'x' AS digest", "2 AS chars").write.parquet(f"{root}/conversations.parquet")
    return str(root)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string"), ("conversations", CONVERSATIONS)):
        spark.createDataFrame([], schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_and_empty_tables(spark, tables_dir, empty_dir, name):
    trie = len(brute_trie([(100, None, "user", None), (100, 1, None, "b"), (100, 1, None, "b"), (101, 0, "user", "x")]))
    n = {"op7_html_text": 3, "op12_prefix_trie": trie}.get(name, len(ODD) + 3)
    assert queries.QUERIES[name](spark, tables_dir).count() == n
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


def test_odd_tables_give_defined_values(spark, tables_dir, library):
    """What the docstrings promise for null, empty, blank and long texts, row by row; rows without an id are two."""
    rows = odd_docs(spark).collect()
    text_of = lambda r: r["text"] or ""
    got = {n: queries.QUERIES[n](spark, tables_dir).collect() for n in queries.QUERIES if not n.startswith("op7")}
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)

    def same(name, *columns, want):
        have = Counter((key(r), *(r[c] for c in columns)) for r in got[name])
        assert have == Counter((key(r), *want(r)) for r in rows), name

    digest = lambda b: hashlib.sha256(b).hexdigest()
    ids = lambda r: library.encode_ordinary(text_of(r))
    same("op2_byte_bpe", "n_tokens", "ids_sha256", "decoded_sha256", want=lambda r: (len(ids(r)), digest(" ".join(map(str, ids(r))).encode()), digest(text_of(r).encode())))
    same("op4_quality_rules", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", want=lambda r: brute_base(r["text"]))
    assert not any(r["kept"] for r in got["op4_quality_rules"] if r["n_words"] < 50)
    same("op6_mixing", "size", want=lambda r: (len(WORD.findall(text_of(r))),))
    tokens = lambda r: len(hugging().encode(text_of(r), add_special_tokens=False).ids)
    same("op8_token_counts", "n_bytes", "n_tokens", "over_limit", want=lambda r: (len(text_of(r).encode()), tokens(r), tokens(r) > 512))
    pids = lambda r: spm().encode(text_of(r))
    same("op11_sentencepiece", "n_tokens", "ids_sha256", "decoded_sha256", want=lambda r: (len(pids(r)), digest(",".join(map(str, pids(r))).encode()), digest(spm().decode(pids(r)).encode())))
    same("op13_periodic_runs", *PERIODIC, want=lambda r: brute_periodic(r["doc_id"], r["text"]))
    same("op9_simhash", "fingerprint", want=lambda r: (f"{brute_fingerprint(r['text']):016x}",))
    same("op3_fingerprints", "n_chars", want=lambda r: (len(text_of(r)),))
    by_text = defaultdict(set)
    for r in got["op3_fingerprints"]:
        by_text[next(text_of(x) for x in rows if x["doc_id"] == r["doc_id"] and len(text_of(x)) == r["n_chars"])].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({f for v in by_text.values() for f in v}) == len(by_text)
    empty = [r["component_id"] for r in got["op9_simhash"] if r["fingerprint"] == "0" * 16]
    assert len(set(empty)) == 1 and empty[0] == min(r["doc_id"] for r in rows if r["doc_id"] is not None and not WORD.search(text_of(r)))
    for name in ("op1_quality", "op5_toxicity"):
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] is not None for r in got[name])
    letterless = {r["doc_id"] for r in rows if not any(c.isalpha() for c in text_of(r))}
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) and (r["doc_id"] not in letterless or r["lang_pred"] == "und") for r in got["op10_language_id"] if r["doc_id"] is not None)


def test_pipeline_on_odd_and_empty_tables(spark, tables_dir, empty_dir):
    assert corpus_pipeline.run(spark, tables_dir).columns[:2] == ["doc_id", "source"]
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


# --- 1 and 5: classifiers


def held_out(spark, name, label):
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", label)
    return [(r["score"], r["predicted"], r[label]) for r in out.where("held_out").join(labels, "doc_id").collect()]


def test_quality_on_held_out_rows(spark):
    rows = held_out(spark, "op1_quality", "quality")
    assert np.mean([p == y for _, p, y in rows]) > 0.93
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p, _ in rows)


def test_toxicity_on_held_out_rows(spark):
    rows = held_out(spark, "op5_toxicity", "toxic")
    assert np.mean([p == y for _, p, y in rows]) > 0.9
    assert sum(y for _, p, y in rows if p) >= 0.5 * sum(y for _, _, y in rows)


def test_labelled_sample_takes_a_doc_id_once(spark):
    rows = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (2, "c"), (3, None), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    got = common.labelled_sample(rows, labels, "quality", F.lit(True), 100)
    assert sorted(map(tuple, got.select("doc_id", "text", "label").collect())) == [(1, "a", 1), (2, "c", 0), (3, "", 0)]


def test_quality_query_against_plain_rules(spark, docs):
    """Every score of the query from the fitted rules, evaluated in plain Python on statistics made in plain Python."""
    part = common.fold(F.col("doc_id"), 3)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rules_, intercept = quality.fit(common.labelled_sample(docs, labels, "quality", part != 1, quality.SAMPLE))
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_quality"](spark, SF).collect()}
    for r in docs.collect():
        s = brute_statistics(r["text"])
        total = intercept + sum(rule.weight for rule in rules_ if all((s[n] > c) == above for n, above, c in rule.terms))
        g = got[r["doc_id"]]
        assert abs(g["score"] - 1 / (1 + np.exp(-total))) < 1e-9 and g["predicted"] == (g["score"] >= 0.5)
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def brute_statistics(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if x]
    count = lambda p: sum(1 for c in text if p(c))
    part = lambda a, b: a / b if b else 0.0
    kind = unicodedata.category
    letters = count(lambda c: kind(c)[0] == "L")
    return {
        "n_words": np.log1p(len(w)), "word_len": part(sum(map(len, w)), len(w)), "capitals": part(count(lambda c: kind(c) == "Lu"), letters),
        "symbols": part(count(lambda c: c in "#*$%&<>"), len(w)), "exclaims": part(text.count("!"), len(w)), "digits": part(count(lambda c: kind(c) == "Nd"), len(w)),
        "stops": part(count(lambda c: c in ".?"), len(w)), "pipes": part(text.count("|"), len(w)), "echoes": part(sum(a == b for a, b in zip(w, w[1:])), len(w)),
        "variety": part(len(set(w)), len(w)), "dup_lines": part(len(lines) - len(set(lines)), len(lines)), "line_words": part(len(w), len(lines)),
    }


def test_toxicity_query_against_plain_search(spark, docs):
    """Every score of the query from the learned weights, with entries looked up word by word instead of by automaton."""
    weights, head = toxicity.learn(spark, SF, docs)
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_toxicity"](spark, SF).collect()}
    for r in docs.collect():
        words = toxicity.folded(r["text"]).split()
        spared = set()
        for phrase in toxicity.EXCEPTIONS:
            k = phrase.split()
            spared |= {i + j for i in range(len(words)) if words[i : i + len(k)] == k for j in range(len(k))}
        best = [max((v for e, v in weights.items() if f" {w} ".startswith(e)), default=0.0) for i, w in enumerate(words) if i not in spared]
        z = np.dot(toxicity.features([("", v) for v in best if v > 0], len(words)), head)
        assert abs(got[r["doc_id"]]["score"] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_entry_counts_and_odds_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HELD", 5)  # counts are handed on early; sums stay
    rng = random.Random(9)
    data = [(" ".join(rng.choice(["alpha", "beta", "badword", "gamma"] if y else ["alpha", "beta", "gamma"]) for _ in range(6)), y, i % 4) for i in range(80) for y in (0, 1)]
    rows = spark.createDataFrame(data, "text string, label int, part int")
    got = {r["entry"]: r for r in toxicity.candidates(rows).collect()}
    for entry in (" badword ", " alp", " gamma"):
        for k in range(4):
            for y, name in ((1, "toxic"), (0, "clean")):
                assert got[entry][f"{name}{k}"] == sum(entry in f" {t} " for t, label, part in data if label == y and part == k)
    models = toxicity.lexicon(rows, Counter((y, k) for _, y, k in data))
    assert all(m[" badword "] > 1 and " alpha " not in m for m in models) and len(models) == 5


def test_rules_compile_to_what_they_say(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "text string")
    model = ([quality.Rule((("n_words", True, 0.5), ("symbols", False, 0.1)), 1.5)], -0.25)
    got = [r[0] for r in rows.select(quality.score(F.col("text"), model)).collect()]
    stats = [r[0] for r in rows.select(quality.statistics(F.col("text"))).collect()]
    want = [1 / (1 + np.exp(-(-0.25 + 1.5 * (s["n_words"] > 0.5 and s["symbols"] <= 0.1)))) for s in stats]
    assert np.allclose(got, want)


def test_lasso_drops_noise():
    rng = np.random.default_rng(0)
    z = (rng.random((2000, 30)) < 0.5).astype(np.float32)
    y = (z[:, 0] + rng.random(2000) * 0.2 > 0.5).astype(float)
    w, _ = quality.lasso(z, y, 0.02)
    assert abs(w[0]) > 1 and np.abs(w[1:]).max() < 0.1


def test_folding_and_exceptions():
    assert toxicity.folded("ІDІ0T! m0r0n $tupid 1diot") == " idiot moron stupid idiot "
    weights = {" trash": 2.0, " idiot": 3.0}
    entries = toxicity.automaton(weights)
    assert toxicity.matches(toxicity.folded("a trash can"), entries, weights) == []
    assert toxicity.matches(toxicity.folded("trash, idiots"), entries, weights) == [(" trash", 2.0), (" idiot", 3.0)]
    assert toxicity.matches(toxicity.folded("unidiot"), entries, weights) == []
    for form in ("тrash", "tràsh", "𝓽𝓻𝓪𝓼𝓱", "tr\u200bash", "t r a s h", "ТRАSН", "ＴＲＡＳＨ", "tra$h", "t.r.a.s.h"):
        assert toxicity.folded(form) == " trash ", form
    assert toxicity.folded("I am a b") == " i am a b "


def test_logistic_weights_stay_put_on_separable_rows():
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(5000), np.where(np.arange(5000) % 10 == 0, 8.0, 0.0), rng.random((5000, 4)) * 6])
    y = (np.arange(5000) % 10 == 0).astype(float)
    w = toxicity._logistic(x, y, np.array([-3.0, 1.0, 0.5, 0.5, 0.0, 0.0]))
    assert np.abs(w).max() < 30 and ((x @ w > 0) == (y > 0)).all()


# --- 2 and 8: tokenizers


@pytest.fixture(scope="module")
def library():
    ranks = bpe.encoder(bpe.RANKS).ranks
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(ranks), special_tokens={})


LETTERS = st.text(st.one_of(st.sampled_from(" \n\t'strevlmd1aé½　́"), st.characters(codec="utf-8")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_bpe_equals_library(text):
    own = bpe.encoder(bpe.RANKS)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=dict(own.ranks), special_tokens={}).encode_ordinary(text) if text else []
    ids = own.encode_all(pa.array([text])).to_pylist()[0]
    assert ids == want and own.decode(ids) == text.encode()


def test_bpe_round_trip_in_spark(spark, docs, library):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op2_byte_bpe"](spark, SF).collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"])
        got = rows[r["doc_id"]]
        assert got["n_tokens"] == len(ids) and got["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_bpe_blocks_and_generations(library):
    own = bpe.Encoder(bpe.RANKS, room=50)
    text = " ".join(f"word{i} x'll" for i in range(3000))
    assert np.frombuffer(own.encode(text, block=100), np.int32).tolist() == library.encode_ordinary(text)
    assert len(own) <= 50 and len(own.older) <= 50


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, max_size=4))
def test_token_counts_equal_library(texts):
    want = [len(e.ids) for e in hugging().encode_batch(texts, add_special_tokens=False)]
    assert tokencount.counter(tokencount.TOKENIZER).count(texts).tolist() == want


def hugging(cache=[]):
    if not cache:
        cache.append(Tokenizer.from_file(tokencount.TOKENIZER))
    return cache[0]


def test_token_counts_of_long_and_special_texts(monkeypatch):
    monkeypatch.setattr(tokencount, "BATCH", 500)
    texts = ["<|endoftext|>", "a<|endoftext|> b", "ab c " * 3000, "x" * 4000, " " * 2000 + "y", "'r 're " * 300]
    want = [len(e.ids) for e in hugging().encode_batch(texts, add_special_tokens=False)]
    assert tokencount.counter(tokencount.TOKENIZER).count(texts).tolist() == want


def test_token_count_query_equals_library(spark, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_token_counts"](spark, SF).collect()}
    for r in docs.collect():
        n = len(hugging().encode(r["text"], add_special_tokens=False).ids)
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(r["text"].encode()), n, n > 512)


def test_other_tokenizers_are_refused(tmp_path):
    file = json.load(open(tokencount.TOKENIZER))
    file["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        tokencount.Merger(str(tmp_path / "t.json"))


def test_merger_forgets_without_harm():
    small = tokencount.Merger(tokencount.TOKENIZER, room=5, states=20)
    full = tokencount.counter(tokencount.TOKENIZER).merger
    words = [f" thing{i}ation" for i in range(60)]
    assert [small[w] for w in words] == [full[w] for w in words]


# --- 3: fingerprints


def test_fingerprints_against_brute_force(spark, docs):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_fingerprints"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    for i, k in enumerate(ids):
        t, n = texts[k], texts[ids[(i + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert rows[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (rows[k]["fingerprint"] == rows[k]["edited_fingerprint"]) == (t == edited)
        assert 0 <= rows[k]["near_edited"] <= 1 and 0 <= rows[k]["near_next"] <= 1
    by_text = defaultdict(set)
    for k, t in texts.items():
        by_text[t].add(rows[k]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({f for v in by_text.values() for f in v}) == len(by_text)


def test_next_document_across_many_ranges(spark):
    ids = random.Random(3).sample(range(10**9), 300)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next"]["text"] for r in merkle.with_next(df, ["text"], rows=7).collect()}
    order = sorted(ids)
    assert got == {k: f"t{order[(i + 1) % len(order)]}" for i, k in enumerate(order)}


def test_next_document_of_null_and_repeated_ids(spark):
    """Ties are ordered by a digest: every row still has one next row, in one ring over all rows."""
    rows = [(None, f"n{i}") for i in range(120)] + [(5, f"f{i}") for i in range(120)] + [(i, f"t{i}") for i in range(60)]
    got = {r["text"]: r["next"]["text"] for r in merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"], rows=7).collect()}
    at, seen = "t0", []
    for _ in rows:
        seen.append(at)
        at = got[at]
    assert at == "t0" and sorted(seen) == sorted(t for _, t in rows)
    assert [t for t in seen if t[0] == "t"] == [f"t{i}" for i in range(60)] and seen[-120:] == [t for t in seen if t[0] == "n"]


def cut(text):
    """Paragraphs as the operator has them."""
    return re.findall(merkle.PARAGRAPH.replace(r"\z", r"\Z"), text)


def test_likeness_and_edits_against_brute_force(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_fingerprints"](spark, SF).collect()}
    for i, k in enumerate(ids):
        t, n = texts[k], texts[ids[(i + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = cut(t), cut(edited), cut(n)
        like = lambda x, y: 2 * len(set(x) & set(y)) / (len(set(x)) + len(set(y))) if x or y else 1.0
        r = got[k]
        assert r["n_chars"] == len(t) and abs(r["near_edited"] - like(a, b)) < 1e-12 and abs(r["near_next"] - like(a, c)) < 1e-12
        assert (r["edit"]["section"], r["edit"]["paragraph"], r["edit"]["removed"], r["edit"]["added"]) == brute_edit(a, b)


def brute_edit(a, b):
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    if len(a) == len(b) == start:
        return 0, 0, 0, 0
    return start // merkle.SECTION + 1, start + 1, len(a) - start - end, len(b) - start - end


def test_an_insertion_is_located(spark):
    old = [f"Sentence number {i} stands here. " for i in range(50)]
    new = old[:20] + ["Put in. ", "Put in too. "] + old[20:]
    rows = spark.createDataFrame([("".join(old), "".join(new)), ("".join(new), "".join(old)), ("", "a"), ("", "")], "a string, b string")
    trees = rows.select(merkle.tree(F.col("a")).alias("x"), merkle.tree(F.col("b")).alias("y"))
    got = [tuple(r[0]) for r in trees.select(merkle.edit(F.col("x"), F.col("y"))).collect()]
    assert got == [(2, 21, 0, 2), (2, 21, 2, 0), (1, 1, 0, 1), (0, 0, 0, 0)]


def test_paragraphs_hold_the_whole_text(spark):
    rows = spark.createDataFrame([(t or "",) for t in ODD], "text string")
    cut = rows.select("text", F.array_join(F.regexp_extract_all("text", F.lit(merkle.PARAGRAPH), F.lit(0)), "").alias("again")).collect()
    assert all(r["text"] == r["again"] for r in cut)


# --- 4: rules


def brute_base(text):
    words = WORD.findall(text or "")
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    covered = {p + j for v in places.values() if len(v) > 1 for p in v for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_counts(spark, docs):
    rows = docs.select("text").union(spark.createDataFrame([(t,) for t in ODD], "text string"))
    for r in rows.select("text", rules.base_counts(F.col("text")).alias("c")).collect():
        c = r["c"]
        assert (c["n_words"], c["word_chars"], c["n_symbols"], c["n_dup_lines"], c["n_repeat_words"]) == brute_base(r["text"])


def test_quality_rules_equal_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    result = con.sql(queries.SQL["op4_quality_rules"])
    got = queries.QUERIES["op4_quality_rules"](spark, "/root/testdata/sf0.01").select(*result.columns)
    assert sorted(map(tuple, got.collect())) == sorted(result.fetchall())


def measured_like(spark, rows):
    """Rows (lang, source, value) as rules.measured would give them, the value in every statistic."""
    schema = "base_failed boolean, lang string, source string, " + ", ".join(f"{k} long" for k in rules.STATISTICS)
    return spark.createDataFrame([(False, lang, source, *[v] * len(rules.STATISTICS)) for lang, source, v in rows], schema)


def test_limits_come_from_the_groups_own_spread(spark):
    """A source of even texts is judged more strictly than one of uneven ones; REACH and the groups both matter."""
    rng = random.Random(4)
    rows = [("en", "even", 480 + rng.randrange(40)) for _ in range(400)] + [("en", "uneven", 300 + rng.randrange(400)) for _ in range(400)]
    rows += [("en", "small", 500)] * 5 + [("de", "flat", 0)] * 300
    sketch = rules.sketches(measured_like(spark, rows))
    got = {r["source"]: r for r in rules.thresholds(sketch).collect()}
    assert got["even"]["marks_high"] < 900 < got["uneven"]["marks_high"]
    assert got["even"]["word_len_low"] > 200 and got["uneven"]["word_len_low"] < 0 and got["even"]["marks_low"] == -1
    pooled = rules.thresholds(sketch.withColumn("source", F.lit("one"))).where("lang = 'en'").first()
    assert got["small"]["marks_high"] == pooled["marks_high"]  # too few documents: its language's
    assert got["flat"]["marks_high"] == rules.limits_of(rules.quantiles(sketch, []), rules.REACH).where("name = 'marks'").first()["high"]
    near = {r["source"]: r for r in rules.thresholds(sketch, reach=1.0).collect()}
    assert near["uneven"]["marks_high"] < 900


def test_statistics_without_any_spread_bind_nothing(spark):
    sketch = rules.sketches(measured_like(spark, [("en", "a", 0)] * 200))
    assert rules.thresholds(sketch).first()["marks_high"] is None


def test_one_text_two_verdicts(spark):
    """The same text is kept in a source of its kind and dropped in another."""
    rng = random.Random(6)
    words = lambda marks: " ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{'-' * rng.randrange(marks)}{chr(97 + i % 26)}" for i in range(80))
    odd = words(40)
    rows = [(i, "en", "clean", words(2)) for i in range(150)] + [(1000 + i, "en", "marked", words(40)) for i in range(150)]
    rows += [(5000, "en", "clean", odd), (5001, "en", "marked", odd)]
    got = {r["doc_id"]: r["kept"] for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert not got[5000] and got[5001] and sum(v for k, v in got.items() if k < 150) >= 148


def test_sketch_quantiles_are_near(spark):
    values = [int(x) for x in np.random.default_rng(2).lognormal(5, 1, 3000)]
    q = rules.quantiles(rules.sketches(measured_like(spark, [("en", "s", v) for v in values])), ["lang", "source"]).first()
    for k, p in (("q25", 25), ("q50", 50), ("q75", 75), ("q90", 90), ("q99", 99)):
        assert abs(rules.GAMMA ** q[k] / (np.percentile(values, p) + 1) - 1) < 0.05


def test_quality_rules_keep_clean_and_drop_junk(spark):
    out = queries.QUERIES["op4_quality_rules"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    c = Counter((r["quality"], r["kept"]) for r in out.where("not base_failed").join(labels, "doc_id").collect())
    assert c[1, False] <= 0.02 * (c[1, True] + c[1, False]) and c[0, True] <= 0.1 * (c[0, True] + c[0, False])


# --- 6: mixing


def test_mix_meets_targets_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op6_mixing"](spark, sf).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(queries.SQL["op6_mixing"]).fetchall()}
    source = dict(con.sql("SELECT doc_id, source FROM documents").fetchall())
    taken, target, total = Counter(), {}, Counter()
    for r in rows:
        size, source_size, goal, took = want[r["doc_id"]]
        assert (r["size"], r["source_size"], r["taken"]) == (size, source_size, took) and abs(r["target"] - goal) < 1e-6 and took <= 2 * size
        s = source[r["doc_id"]]
        taken[s] += took
        total[s] += size
        target[s] = goal
    assert abs(sum(target.values()) - 1.5 * sum(total.values())) < 1e-3
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] and target[s] <= 2 * total[s] + 1e-6 for s in total)


def test_mix_draws_null_and_repeated_ids_row_by_row(spark):
    rows = [(None, f"w {'x ' * (i % 9)}", "a") for i in range(3000)] + [(7, "p q r s", "b")] * 3000 + [(i, "one two three", "c") for i in range(2000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sums = out.groupBy("doc.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 5 and r["most"] <= 2 for r in sums) and len(sums) == 3


def test_scales_fill_the_rest(spark):
    """The words expected are the rest, also where the longest documents are certain."""
    sizes = [1] * 50 + [10] * 20 + [5000]
    rows = spark.createDataFrame([("s", k, n) for k, n in Counter(sizes).items()], "source string, size long, n long")
    for rest in (10.0, 200.0, 5100.0, 5249.0):
        scale = mixing.scales(rows, spark.createDataFrame([("s", rest)], "s string, rest double")).first()["scale"]
        assert abs(sum(k * min(1.0, scale * k) for k in sizes) - rest) < 1e-6


def test_water_filling_stops_at_caps(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 400)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got["a"] == 20 and got["b"] <= 2000 and abs(sum(got.values()) - 1.5 * 2410) < 1e-6


# --- 7: pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><a href="/">Site</a></header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies, and this is a long notice about them all.</div><main><article><h1>Head &amp; tail</h1>
<p>First <b>bold</b>   paragraph, long enough to be content &eacute;.</p><p>Short.<p>Unclosed paragraph that goes on for a while.<div class="ad">Buy now!</div>
<form><label>Name</label><input></form><aside>Side</aside></article><section class="comments"><p>A reader says something that is rather long too.</p></section></main><footer>Foot</footer></body></html>"""


def test_main_text():
    assert webtext.main_text(PAGE) == "Head & tail\nFirst bold paragraph, long enough to be content é.\nShort.\nUnclosed paragraph that goes on for a while."
    assert webtext.main_text(None) == webtext.main_text("") == webtext.main_text("<nav>x</nav>") == ""
    assert webtext.main_text("<p>a paragraph that the page's end cuts &amp") == "a paragraph that the page's end cuts &"
    assert webtext.main_text("<p>whole text</p><di") == "whole text"


def test_region_holds_most_of_the_content():
    text = "".join(f"<p>Paragraph {i} of the text proper, which goes on for quite a while here.</p>" for i in range(6))
    want = "\n".join(re.findall("<p>(.*?)</p>", text))
    card = "<article><p>A card about something else, long enough to pass.</p></article>"
    for page in (f"<body><div>{text}</div>{card}</body>", f"<body><article>{text}</article>{card}</body>", f"<body><main>{text}</main>{card}</body>"):
        assert webtext.main_text(page) == want


def paragraphs(n, of="the text proper"):
    return "".join(f"<p>Paragraph {i} of {of}, which goes on for quite a while here.</p>" for i in range(n))


def shown(*parts):
    return "\n".join(t for p in parts for t in re.findall(r"<(?:p|h1|h2|td)[^>]*>(.*?)</(?:p|h1|h2|td)>", p))


CELL = " ".join(f"Sentence {i} of a cell that holds running text." for i in range(9))
WIDE_PAGES = {
    "two sections": f"<main><section>{paragraphs(9)}</section><section>{paragraphs(3, 'another section')}</section></main>",
    "two divs": f"<div><div>{paragraphs(7)}</div><div>{paragraphs(3, 'the second part')}</div></div>",
    "title before the body": f"<main><h1>Big title</h1><div class=body>{paragraphs(6)}</div></main>",
    "title and lead": f"<div><div><h1>Big title</h1><p>The lead of it, a sentence that says what follows.</p></div><div>{paragraphs(8)}</div></div>",
    "two cells": f"<table><tr><td>{CELL}</td><td>{CELL} And more of it.</td></tr></table>",
    "two articles": f"<main><article>{paragraphs(8)}</article><article>{paragraphs(3, 'the other')}</article></main>",
    "class names of compound words": f"<article>{paragraphs(3)}<p class='ad-hoc'>An ad hoc remark that is as long as any other line.</p><div class='menu-plan'>{paragraphs(2, 'the plan')}</div></article>",
}


@pytest.mark.parametrize("kind", WIDE_PAGES)
@pytest.mark.parametrize("around", ["", "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>Blog</a></li></ul></nav>"])
def test_no_part_of_the_text_is_lost(kind, around):
    page = f"<html><body>{around}{WIDE_PAGES[kind]}<footer>Foot of the site</footer></body></html>"
    want = shown(WIDE_PAGES[kind])
    assert webtext.main_text(page) == (want.replace("\n", " ") if "<td>" in page else want)  # a row is one block


def test_what_stands_around_stays_out():
    links = "".join(f"<li><a href='/{i}'>Another page {i}</a></li>" for i in range(8))
    for beside in (f"<div><h2>Latest</h2><ul>{links}</ul></div>", "<div class='comments'><p>A reader says something that is rather long too, longer than most.</p></div>", "<div><p>One card.</p></div>"):
        for page in (f"<body><div>{paragraphs(6)}</div>{beside}</body>", f"<body>{beside}<div>{paragraphs(6)}</div></body>", f"<body><main><div>{paragraphs(6)}</div>{beside}</main></body>"):
            assert webtext.main_text(page) == shown(paragraphs(6)), page


def divided(page):
    """The page with its article as nested divs, the title outside."""
    return re.sub(r"<article>(\s*<h1>.*?</h1>)?(.*?)</article>", r"<div>\1<div>\2</div></div>", page, flags=re.S)


def test_articles_as_divs_give_the_same(spark):
    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert np.mean([webtext.main_text(page) == webtext.main_text(divided(page)) for page in rows]) >= 0.95


def nameless(page):
    """The page without classes, ids and the names of its elements' roles."""
    page = re.sub(r"<(/?)(article|nav|footer|header|aside|main|section|form)\b", r"<\1div", page)
    return re.sub(r"(<div)[^>]*>", r"\1>", page)


def test_method_alone_finds_the_article(spark):
    """With all names gone, ratios, smoothing and threshold choose the region; without them, fewer pages come out right."""
    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    right = [webtext.main_text(page) == webtext.main_text(nameless(page)) for page in rows]
    assert np.mean(right) >= 0.9


def test_clusters_decide(monkeypatch):
    """A long list of links outweighs a short article unless its lines fall into the lower cluster."""
    links = "".join(f"<li><a href='/{i}'>Another page to read {i}</a></li>" for i in range(60))
    text = "".join(f"<p>Paragraph {i} of the text, which goes on for quite a while, as paragraphs of text do.</p>" for i in range(4))
    page = f"<body><div><ul>{links}</ul></div><div>{text}</div></body>"
    want = "\n".join(re.findall("<p>(.*?)</p>", text))
    assert webtext.main_text(page) == want
    monkeypatch.setattr(webtext, "content_lines", lambda ratios: (np.ones(len(ratios), bool), 0.0))
    assert webtext.main_text(page) != want


def test_names_only_weigh_in():
    text = "".join(f"<p>Paragraph {i} of the text, which goes on for quite a while, as paragraphs of text do.</p>" for i in range(4))
    want = "\n".join(re.findall("<p>(.*?)</p>", text))
    for open_, close in (("<form>", "</form>"), ("<div class='page-comments-form'>", "</div>"), ("<div id='sidebar'>", "</div>"), ("<div class='search widget'>", "</div>")):
        assert webtext.main_text(f"<body><nav><a href='/'>Home</a></nav>{open_}{text}{close}<footer>Foot</footer></body>") == want
    related = "<p class='related'>This paragraph is about related work, and it is as much text as any other one here.</p>"
    cards = "<div class='related'><a href='/a'>One</a><a href='/b'>Two</a></div>"
    assert webtext.main_text(f"<body><article>{text}{related}{cards}{text}</article></body>").count("related work") == 1
    assert "One" not in webtext.main_text(f"<body><article>{text}{cards}</article></body>")


def test_pages_give_their_article(spark):
    import html as H

    for r in queries.QUERIES["op7_html_text"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").drop("url"), "page_id").collect():
        body = webtext.TAIL.sub("", r["html"].split("<article>")[1].split("</article>")[0])
        blocks = [" ".join(H.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


# --- 9: near duplicates


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4) + i + 1:
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_simhash_of_odd_texts():
    assert [simhash.simhash(t) for t in ODD] == [brute_fingerprint(t) for t in ODD]


def test_links_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for s in seeds for _ in range(8)} | {0, 1, 15, 31, (1 << 64) - 1})
    monkeypatch.setattr(simhash, "LIMIT", 20_000)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for prefix, hot in ((8, 50_000), (12, 50_000), (8, 20)):
        monkeypatch.setattr(simhash, "HOT", hot)
        pairs = simhash.links(df, prefix)
        assert all((int(np.int64(r["a"]).view(np.uint64)) ^ int(np.int64(r["b"]).view(np.uint64))).bit_count() == r["bits"] <= 4 for r in pairs.collect())
        roots = {r["node"]: r["root"] for r in simhash.components(pairs).collect()}
        got, want = defaultdict(set), defaultdict(set)
        for x, y in zip(signed, brute_components(fps)):
            got[roots.get(x, x)].add(x)
            want[y].add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_crowded_range_is_halved():
    fps = np.arange(3000, dtype=np.uint64)
    a, b = (np.concatenate(x) for x in zip(*simhash.collisions(fps, np.full(3000, 2), 56)))
    x, y = simhash.forest(3000, a, b)
    assert len(x) == 2999 and (np.bitwise_count(fps[x] ^ fps[y]) <= 4).all()
    assert len(set(brute_roots(3000, zip(x.tolist(), y.tolist())))) == 1


def brute_roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("few", [200_000, 0])
def test_components_of_a_chain(spark, monkeypatch, few):
    monkeypatch.setattr(stars, "FEW", few)
    chain = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1000, 999)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(chain).collect()}
    assert {roots[i] for i in range(1, 201)} == {0} and roots[1000] == 999


def test_near_duplicates_in_spark(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    roots = brute_components([brute_fingerprint(texts[k]) for k in ids])
    got = {r["doc_id"]: r["component_id"] for r in queries.QUERIES["op9_simhash"](spark, SF).collect()}
    assert got == {k: ids[r] for k, r in zip(ids, roots)}


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(3, text, None, "s", 1), (1, text, None, "s", 1), (1, text, None, "s", 1), (2, "other words entirely here", None, "s", 1), (None, "alone and without id", None, "s", 1), (None, "alone and without id", None, "s", 1)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["text"][:5]) for r in kept) == [("1", "w0 w1"), ("2", "other"), ("None", "alone")]


def test_one_of_each_goes_by_row(spark):
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(300))
    for ids in (((1, a), (5, a), (5, b)), ((5, a), (5, b)), ((5, a), (5, b), (5, b))):
        kept = simhash.one_of_each(spark.createDataFrame([(i, t, None, "s", 1) for i, t in ids], SCHEMA)).collect()
        assert sorted((r["doc_id"], r["text"][0]) for r in kept) == [(min(i for i, t in ids if t == a), "a"), (5, "b")]


def brute_shingles(text):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)}


def test_parities_bound_the_difference(spark):
    """Folded or not, parities never differ in more buckets than sets do in shingles."""
    rng = np.random.default_rng(2)
    for n, m, common in ((900, 1100, 800), (3000, 3300, 2900), (1020, 1030, 1000), (4000, 4200, 10), (1, 1, 1)):
        h = rng.integers(0, 1 << 63, n + m, dtype=np.int64).view(np.uint64)
        a, b = h[:n], np.concatenate((h[:common], h[n : n + m - common]))
        df = spark.createDataFrame([(likeness.parities(a).tolist(), likeness.parities(b).tolist())], "a array<long>, b array<long>")
        got = df.select(likeness.differing(F.col("a"), F.col("b"))).first()[0]
        assert got <= n + m - 2 * common and (got > 0.15 * (n + m - 2 * common) or common == n)


def test_outsiders_of_a_hot_shingle_cost_no_square(spark):
    """One shingle of 20,000 sets of a group and five others: each pair of groups meets, in about as many rows as sets."""
    n = 20_005
    hot = spark.range(n).select(F.lit(7).cast("long").alias("h"), F.col("id").alias("set"), F.lit(9).alias("n"), F.lit(0).alias("at"))
    groups = spark.range(n).select(F.col("id").alias("set"), F.when(F.col("id") < 20_000, 0).otherwise(F.col("id")).alias("root"))
    sent = likeness.dealt(hot, groups)
    assert sent.count() <= 2 * n
    mixed = sent.where("kind = 0").groupBy("i", "j").agg(F.count_if("out").alias("o"), F.count_if(~F.col("out")).alias("m")).collect()
    assert all(r["o"] == 5 for r in mixed) and sum(r["m"] for r in mixed) == 20_000 and max(r["m"] for r in mixed) < 2 * likeness.PART
    assert [r["count"] for r in sent.where("kind = 1").groupBy("i", "j").count().collect()] == [5]


@pytest.mark.parametrize("run", [2000, 3])
def test_one_of_each_finds_all_near_copies(spark, monkeypatch, run):
    monkeypatch.setattr(likeness, "RUN", run)
    monkeypatch.setattr(likeness, "PART", 4)
    monkeypatch.setattr(likeness, "BLOCK", 300 if run == 3 else 1 << 22)
    monkeypatch.setattr(likeness, "LAST", 20)
    rng = random.Random(8)
    common_part = [f"c{i}" for i in range(60)]
    texts = list(ODD) + [" ".join(common_part + [f"v{i}x{j}" for j in range(12 + i % 3)]) for i in range(12)]
    for k in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((4, 5, 9, 60, 300)))]
        texts.append(" ".join(words))
        for _ in range(2):
            other = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 40)):
                other[rng.randrange(len(words))] = f"y{rng.randrange(5000)}"
            texts.append(" ".join(other).upper())
    sets, fps = [brute_shingles(t) for t in texts], [brute_fingerprint(t) for t in texts]
    root, missed = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            like = bool(sets[i] and sets[j]) and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))
            near = (fps[i] ^ fps[j]).bit_count() <= 4
            missed += like and not near
            if (like or near) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert missed > 10
    kept = simhash.one_of_each(spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root))


# --- 10: language


def test_language_on_held_out_rows(spark):
    out = queries.QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def brute_cells(text):
    """n-grams as tuples of letters, counted without hashing."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    padded = " " + " ".join("".join(c if c.isalpha() else " " for c in low).split()) + " "
    grams = [padded[i : i + k] for k in (1, 2, 3) for i in range(len(padded) - k + 1)]
    return Counter(g for g in grams if g != " ")


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 20])
def test_cells_do_not_depend_on_blocks(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    for text in ["Some words, and Öther ones! " * 3, " x", "a", "ab1cd", "  12 a ", "日本語 テキスト", "İi"]:
        got = Counter(np.concatenate(list(langid.cells(text))).tolist())
        assert sorted(got.values()) == sorted(brute_cells(text).values()), text
    assert list(langid.cells("12 !")) == list(langid.cells("")) == []


def test_language_scores_equal_plain_sums(monkeypatch):
    rng = np.random.default_rng(1)
    model = (["a", "b"], np.log(np.vstack([[0.3, 0.7], rng.dirichlet(np.ones(langid.BUCKETS), 2).T])).astype(np.float32))
    texts = ["Some words, and Öther ones! " * 3, "", "short", None, "123 !", "x" * 500]
    for entries in (1 << 18, 8):
        monkeypatch.setattr(langid, "ENTRIES", entries)
        names, scores = langid.predict(texts, *model)
        for text, name, score in zip(texts, names, scores):
            cells = np.concatenate([np.zeros(0, np.int64), *langid.cells(text or "")])
            if not len(cells):
                assert (name, score) == ("und", 0.0)
                continue
            sums = model[1][1 + cells].astype(np.float64).sum(axis=0) + model[1][0]
            share = np.exp((sums - sums.max()) / len(cells) ** langid.TEMPER)
            assert name == model[0][int(sums.argmax())] and abs(score - share.max() / share.sum()) < 1e-6
    assert langid.predict(["text"], [], np.zeros((langid.BUCKETS + 1, 0), np.float32)) == (["und"], [0.0])


def test_language_query_against_plain_naive_bayes(spark, docs):
    """The whole query against a dictionary of n-grams, without hashing."""
    rows = docs.select("doc_id", "text", "lang").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    sums, n_docs = defaultdict(Counter), Counter()
    for r in rows:
        if not held[r["doc_id"]] and r["lang"] is not None and (grams := brute_cells(r["text"])):
            sums[r["lang"]].update(grams)
            n_docs[r["lang"]] += 1
    size = {k: sum(c.values()) + langid.ALPHA * langid.BUCKETS for k, c in sums.items()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_language_id"](spark, SF).collect()}
    same = 0
    for r in rows:
        grams = brute_cells(r["text"])
        score = {k: np.log(n_docs[k]) + sum(n * np.log((sums[k][g] + langid.ALPHA) / size[k]) for g, n in grams.items()) for k in sums}
        assert got[r["doc_id"]]["held_out"] == held[r["doc_id"]]
        same += got[r["doc_id"]]["lang_pred"] == max(sorted(score), key=score.get)
    assert same >= 0.99 * len(rows)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.fit(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "lang string, text string"))


# --- pipeline


def test_stages_one_by_one(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    assert names == ["language_id", "toxicity", "near_duplicates", "mixing", "encoding"]
    one = stage["language_id"](spark, docs, SF)
    assert one.columns == docs.columns and one.count() >= 0.98 * docs.count()
    two = stage["toxicity"](spark, one, SF)
    model = toxicity.learn(spark, SF, one)
    scores = {r["doc_id"]: r["s"] for r in one.select("doc_id", toxicity.toxicity(F.col("text"), model, spark)["score"].alias("s")).collect()}
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(k for k, s in scores.items() if s < 0.5)
    three = stage["near_duplicates"](spark, two, SF)
    texts = {r["doc_id"]: r["text"] for r in two.collect()}
    ids = sorted(texts)
    # the stage links by operator 9's rule and, besides, by a Jaccard likeness of 0.8 of five-word sets
    near = brute_components([brute_fingerprint(texts[k]) for k in ids])
    sets = [brute_shingles(texts[k]) for k in ids]
    alike = [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] and sets[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    roots = brute_roots(len(ids), [*enumerate(near), *alike])
    assert sorted(r["doc_id"] for r in three.collect()) == sorted({ids[r] for r in roots})
    four = stage["mixing"](spark, three, SF)
    copies = {r["doc"]["doc_id"]: r["copies"] for r in mixing.mix(three).collect()}
    assert Counter(r["doc_id"] for r in four.collect()) == Counter({k: n for k, n in copies.items() if n})
    five = stage["encoding"](spark, four, SF)
    assert five.count() == four.count() and five.where("size(token_ids) <> n_tokens").count() == 0


def test_stages_keep_extra_columns(spark, docs):
    wide = docs.selectExpr("*", "1 AS size", "2 AS got", "3 AS doc", "4 AS copies", "5 AS id", "6 AS n", "7 AS fp", "8 AS target")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, SF).columns == wide.columns, name


def test_uniform_is_uniform(spark):
    u = [r[0] for r in spark.range(4000).select(common.uniform(F.col("id"))).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02


def test_modules_import_alone():
    for name in ("bpe", "langid", "merkle", "mixing", "quality", "rules", "simhash", "tokencount", "toxicity", "webtext"):
        importlib.import_module(f"corpusmill.llm.{name}")
    assert T is not None


# --- 11: SentencePiece


def spm():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


MARKED_TEXTS = st.text(alphabet=st.one_of(st.sampled_from(" ▁abthe\n\t<>/s0x41é日本🙂\u3000\xa0"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(MARKED_TEXTS, max_size=6))
def test_pieces_equal_library(texts):
    table, model = pieces.pieces(pieces.MODEL), spm()
    ids = table.encode_all(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [model.encode(t) for t in texts]
    assert table.decode_all(ids).to_pylist() == [model.decode(i) for i in ids.to_pylist()]


def test_long_words_runs_of_markers_and_forgetting():
    model = spm()
    table = pieces.Pieces(pieces.MODEL, words=3, chars=50)
    texts = [" " * 40, " " * 17 + "the  the" + " " * 33, "the" * 3000, "日本語テキスト" * 500, "a b c d e f a b c", "x" * 49, "a b c d e f a b c"]
    assert table.encode_all(pa.array(texts)).to_pylist() == [model.encode(t) for t in texts]
    assert len(table.table) <= 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.sampled_from([0, 1, 2, 259, 28705, 3 + 0xE2, 3 + 0x82, 3 + 0xAC, 3 + 0xFF, 3 + 0xC3])), max_size=8))
def test_any_ids_decode_as_the_library_does(ids):
    assert pieces.pieces(pieces.MODEL).decode_all(pa.array([ids, None], pa.list_(pa.int32()))).to_pylist() == [spm().decode(ids), None]


def test_piece_query_equals_library(spark, docs):
    model, texts = spm(), {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = queries.QUERIES["op11_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = model.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(model.decode(ids)))


def test_models_with_pieces_over_markers_are_refused(monkeypatch):
    class Crossing(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b" if i == 400 else super().id_to_piece(i)

    monkeypatch.setattr(pieces.sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError):
        pieces.Pieces(pieces.MODEL)


# --- 12: conversation trie


def brute_trie(rows):
    """Nodes of the trie over rebuilt conversations, straight from the contract."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    plain = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = plain.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    parents = {p[:-1] for p in members if p}
    leaves, saved, kids = Counter(), Counter(), Counter(p[:-1] for p in members if p)
    for p, of in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in parents
            saved[p[:d]] += (len(of) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(whole[c]) == len(p))
        out.append((min(of), len(p), min(members[p[:-1]]) if p else None, len(of), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(df):
    return sorted((tuple(r) for r in df.select(turntrie.COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("size, bound", [(2, 0), (3, 50_000), (2048, 50_000)])
def test_trie_does_not_depend_on_shards(spark, size, bound):
    r = random.Random(5)
    rows = [
        (c, t if r.random() > 0.05 else None, r.choice(["user", None, ""]), r.choice(["a", "bb", None]))
        for c in r.sample(range(-300, 600), 200)
        for t in range(r.choice([1, 1, 2, 3, 9, 12]))
    ]
    df = spark.createDataFrame([*rows, (None, 1, "user", "x")], CONVERSATIONS)
    assert trie_rows(turntrie.prefix_trie(turntrie.rebuilt(df), size, bound)) == brute_trie(rows)


def test_trie_of_many_copies_and_a_long_conversation(spark):
    """One beginning and one whole conversation shared by most: border rows go by shards, not by conversations."""
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(3)] + [(1000, t, "user", str(t)) for t in range(700)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    convs = turntrie.rebuilt(df)
    assert trie_rows(turntrie.prefix_trie(convs, 16)) == brute_trie(rows)


def test_trie_query_equals_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = trie_rows(queries.QUERIES["op12_prefix_trie"](spark, sf))
    assert got == sorted(con.sql(queries.SQL["op12_prefix_trie"]).fetchall(), key=repr)
    assert got == brute_trie([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_plain_sequences(spark):
    """The operator without the query's rebuilding."""
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "a", "b"), (2, 0, "u", "a"), (2, 1, "a", "c")], CONVERSATIONS)
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in turntrie.prefix_trie(turntrie.sequences(df)).collect()}
    assert got == {(1, 0): (None, 2, 1, 2, 1), (1, 1): (1, 2, 2, 2, 1), (1, 2): (1, 1, 0, 1, 0), (2, 2): (1, 1, 0, 1, 0)}


# --- 13: periodic runs

PERIODIC = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def brute_runs(w):
    """Every lag over every word, and every smaller period tried on what is found."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            if i > s and e - s >= max(6, 4 * q) and not any(w[s : e - p] == w[s + p : e] for p in range(1, q)):
                out.add((s, e - s, q))
            i += 1
    return sorted(out)


def brute_periodic(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    return len(runs), s, n, q, 1000 * n // q if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(kept)


@settings(max_examples=500, deadline=None)
@given(st.data())
def test_runs_equal_brute_force(data):
    w = data.draw(st.lists(st.integers(0, data.draw(st.sampled_from([0, 1, 2, 20]))), max_size=60))
    for _ in range(data.draw(st.integers(0, 3)) if w else 0):
        a, p, n = data.draw(st.integers(0, len(w) - 1)), data.draw(st.integers(1, 9)), data.draw(st.integers(0, 50))
        for i in range(a + p, min(len(w), a + n)):
            w[i] = w[i - p]
    assert periodic.runs_of(w) == brute_runs(w)


def test_rounds_bound_the_splitting_only(monkeypatch):
    r = random.Random(2)
    w = [r.randrange(3) for _ in range(400)]
    want = periodic.runs_of(w)
    monkeypatch.setattr(periodic, "ROUNDS", 0)
    assert periodic.runs_of(w) == want == brute_runs(w)


def test_long_texts_of_one_word_and_of_two(spark):
    assert periodic.runs_of([b"a"] * 100_000) == [(0, 100_000, 1)]
    assert periodic.runs_of([i % 3000 for i in range(20_000)]) == [(0, 20_000, 3000)]
    nested = ([0] * 9 + [1]) * 500
    assert periodic.runs_of(nested)[:3] == [(0, 9, 1), (0, 5000, 10), (10, 9, 1)] and len(periodic.runs_of(nested)) == 501


def test_periodic_query_equals_brute_force(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.QUERIES["op13_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(texts) and any(r["n_runs"] for r in rows)
    for r in rows:
        if len(texts[r["doc_id"]] or "") < 12_000:
            assert tuple(r[c] for c in PERIODIC) == brute_periodic(r["doc_id"], texts[r["doc_id"]])
