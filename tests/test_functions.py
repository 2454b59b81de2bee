import json

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import textfns
from corpusmill.operators.evaluation import rank_overlap
from corpusmill.operators.selection import diverse
from corpusmill.sources import sinks, tables


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_normalising_twice_changes_nothing(text):
    once = textfns.normalized(text)
    assert textfns.normalized(once) == once or textfns.normalized(textfns.normalized(once)) == textfns.normalized(once)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab c", max_size=900), max_size=6))
def test_chunks_hold_every_paragraph(paragraphs):
    chunks = textfns.chunk_paragraphs("\n\n".join(paragraphs))
    assert all(0 < len(c) <= 680 for c in chunks)  # 600 and the 80 characters before
    for p in (p.strip() for p in paragraphs):
        assert not p or any(p[:80] in c for c in chunks)


def test_chunks_overlap_in_prose_only():
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| row {i} | {'x' * 40} |" for i in range(30))
    text = "word " * 200 + "\n\n" + table + "\n\n" + "tail " * 10 + "\n\n" + "y" * 590
    chunks = textfns.chunk_paragraphs(text)
    rows = [c for c in chunks if c.startswith("|")]
    assert len(rows) > 2 and all(c.startswith("| a | b |\n| --- | --- |\n| row") and len(c) <= 600 for c in rows)
    assert [r for c in rows for r in c.split("\n")[2:]] == table.split("\n")[2:]
    assert chunks[1].startswith(("word " * 200).strip()[:600][-80:].strip()) and chunks[-2] == ("tail " * 10).strip()
    assert chunks[-1] == ("tail " * 10).strip()[-80:] + "y" * 590
    long_row = "| " + "z" * 900 + " |"
    assert textfns.chunk_paragraphs(f"| h |\n{long_row}") == [f"| h |\n{long_row}"]
    assert textfns.chunk_paragraphs("| h |\n|---|") == ["| h |\n|---|"] and textfns.chunk_paragraphs(" \n\n ") == []


def test_anchors():
    text = "One two three.  Four FIVE six seven.\nAgain and again, again and again."
    got = textfns.anchors(text, ["two", "ONE  TWO three. four", "again", "Four five six seven. AGAIN nothing of this", "", None, "nowhere to be found"])
    assert got == [("exact", 4, 7), ("normalized", 0, 20), None, ("prefix", 16, 40), None, None, None]
    assert text[16:40] == "Four FIVE six seven.\nAga"
    assert textfns.anchors("", ["a"]) == [None] and textfns.anchors("aaa", ["aa"]) == [None]


def test_column_functions(spark):
    rows = spark.createDataFrame([("a\x00  b \n\n\n\n c",), ("",), (None,)], "t string").select(
        textfns.clean_text(F.col("t")).alias("c"), textfns.script_language(F.col("t")).alias("s"), textfns.token_estimate(F.col("t")).alias("n")
    )
    assert [tuple(r) for r in rows.collect()][:2] == [("a\x00 b c", "en", 1), ("", "unknown", 0)]


def brute_overlap(a, b, p=0.9):
    depth = max(len(a), len(b))
    if not depth:
        return None
    shared = lambda n: len(set(a[:n]) & set(b[:n]))
    return round(shared(depth) / depth * p**depth + (1 - p) / p * sum(shared(n) / n * p**n for n in range(1, depth + 1)), 4)


def test_rank_overlap(spark):
    pairs = [([1, 2, 3], [1, 2, 3]), ([1, 2], [3, 4]), ([], []), ([1], []), ([1, 2, 3, 4, 5], [2, 1]), ([5, 4], [4, 5, 6, 7])]
    rows = spark.createDataFrame(pairs, "a array<int>, b array<int>").select("a", "b", rank_overlap(F.col("a"), F.col("b")).alias("x")).collect()
    assert all((r["x"] is None) == (brute_overlap(r["a"], r["b"]) is None) and abs((r["x"] or 0) - (brute_overlap(r["a"], r["b"]) or 0)) <= 1e-4 for r in rows)
    assert rows[0]["x"] == 1 and rows[1]["x"] == 0


def test_diversity_of_weight_one_is_plain_ranking_and_quotas_give_way():
    rng = np.random.default_rng(1)
    rows = [{"embedding": rng.random(4), "source": "a", "month": i % 4} for i in range(12)]
    assert diverse(rows, 1.0, 8, 99, 99) == list(range(8))
    # of one source two at most once three are in; the rest is let in by rank, since nothing else is there
    assert diverse(rows, 1.0, 8, 2, 99) == list(range(8))
    mixed = [{"embedding": [1.0, 0.0], "source": "b" if i > 8 else "a", "month": None} for i in range(12)]
    assert diverse(mixed, 1.0, 6, 2, 3) == [0, 1, 2, 9, 10, 3]
    same = [{"embedding": [1.0, 0.0], "source": None, "month": None}] * 3 + [{"embedding": [0.0, 1.0], "source": None, "month": None}]
    assert diverse(same, 0.5, 2) == [0, 3]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.booleans()), min_size=1, max_size=12), st.floats(0, 1))
def test_diversity_against_plain_greedy(items, weight):
    vectors = [[1.0, 0.2], [0.3, 1.0], [-1.0, 0.5]]
    rows = [{"embedding": vectors[v], "source": s if known else None, "month": v} for v, s, known in items]
    unit = np.array([r["embedding"] for r in rows]) / np.linalg.norm([r["embedding"] for r in rows], axis=1, keepdims=True)
    chosen, left = [], list(range(len(rows)))
    while left and len(chosen) < 5:
        ok = [i for i in left if len(chosen) < 3 or not any(rows[i][k] is not None and sum(rows[j][k] == rows[i][k] for j in chosen) >= m for k, m in (("source", 2), ("month", 3)))]
        if not ok:
            break
        gain = {i: weight * (1 - i / len(rows)) - (1 - weight) * max((float(unit[i] @ unit[j]) for j in chosen), default=0.0) for i in ok}
        best = max(ok, key=lambda i: (round(gain[i], 12), -i))
        chosen.append(best)
        left.remove(best)
    got = diverse(rows, weight, 5, 2, 3)
    assert len(got) == min(5, len(rows)) and len(set(got)) == len(got)
    if len({round(x, 9) for x in gain.values()} if chosen else ()) > 1 and weight in (0.0, 1.0):
        assert got == chosen + left[: 5 - len(chosen)]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, sinks.replace_children(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sinks.without_tombstones(old, new, ["k"]).count() == 1
    assert sinks.export_csv(spark.createDataFrame([("=1",), ("x",)], "v string"), str(tmp_path / "csv"), 1, [F.col("v")])
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first()["v"] == "'=1"
    days = spark.createDataFrame([("d1", 1), ("d2", 2)], "day string, n int")
    sinks.overwrite_days(days, str(tmp_path / "days"))
    sinks.overwrite_days(spark.createDataFrame([("d2", 5)], "day string, n int"), str(tmp_path / "days"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "days")).select("day", "n").collect())) == [("d1", 1), ("d2", 5)]


def test_spool_reader_keeps_good_lines(spark, tmp_path):
    good = {"observed_at": "2024-01-01T00:00:00Z", "host": "h", "scope": "s", "subject": "x", "metrics": {"a": 1.5}, "states": {"b": "up"}}
    (tmp_path / "spool.jsonl").write_text(json.dumps(good) + "\n" + '{"observed_at": "2024')
    rows, rejects = tables.observations(spark, str(tmp_path))
    assert sorted((r["metric"], r["value"], r["state"]) for r in rows.collect()) == [("a", 1.5, None), ("b", None, "up")]
    assert rejects.count() == 1
    assert tables.settled_files(spark, str(tmp_path), [".jsonl"], 0).count() == 1


def test_sidecars_name_their_problems(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title": "t", "market": null}')
    assert tables.sidecars(spark, str(tmp_path), {"title": "string", "market": "string"}).first()["problems"] == ["missing:market"]


def test_all_parts_are_found_in_one_pass():
    text = "aaaa bab ab"
    found = textfns.places_of(text, ["aa", "ab", "bab", "", "zz", "aaaa bab ab"])
    assert found == {"aa": (0, 3), "ab": (6, 2), "bab": (5, 1), text: (0, 1)}
    assert textfns.places_of("", ["a"]) == {} and textfns.places_of("abc", []) == {}


def test_four_hundred_planted_chunks_are_all_anchored():
    """Chunks of the real chunker, of texts with paragraphs, wide characters and broken lines: the naive search finds few."""
    import random

    r = random.Random(6)
    anchored = naive = total = 0
    while total < 400:
        paragraphs = [" ".join("".join(r.choice("abcde台積電報告ＡＢ") for _ in range(r.randint(2, 9))) for _ in range(r.randint(5, 200))) for _ in range(r.randint(2, 9))]
        text = "\n\n".join(paragraphs)
        chunks = textfns.chunk_paragraphs(text)
        stored = [c.upper().replace(" ", "  ") if i % 3 == 0 else c for i, c in enumerate(chunks)]  # as an extraction may give them
        places = textfns.chunk_anchors(text, stored)
        naive += sum(c in text for c in stored)
        for c, found in zip(stored, places):
            alone = len(textfns.normalized(c)) > 120  # a shorter one, with its overlap, may have nothing left to look for
            total += alone
            if found and alone:
                how, start, stop, at = found
                part, whole = textfns.normalized(text[start:stop]), textfns.normalized(c)
                assert part in whole and (how == "middle" or whole.endswith(part)) and at == len(textfns.normalized(text[:start]))
                anchored += 1
    assert anchored == total and naive < total / 2


def test_chunks_that_are_not_there():
    assert textfns.chunk_anchors("some text", ["other", "", None, "SOME  text"]) == [None, None, None, ("rest", 0, 9, 0)]
    body = "".join(chr(0x4E00 + i) for i in range(300))
    changed = "x" * 80 + body[80:280] + "zz"  # neither the rest nor the whole, but its middle
    assert textfns.chunk_anchors(body, [changed])[0][0] == "middle" and textfns.chunk_anchors("", ["a"]) == [None]


def test_plain_and_wide_texts_have_the_same_normal_form(spark):
    texts = ["Plain  Text\t\x1c\x1fwith\ngaps", "ＷＩＤＥ　Text", "é ﬁ", "", None, "a\x85b", "A\x00B"]
    got = {r["t"]: r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", textfns.norm_for_match("t").alias("n")).collect()}
    assert got == {t: None if t is None else textfns.normalized(t) for t in texts}


def test_metrics_with_bad_names_or_values_are_passed_over(spark):
    from corpusmill.operators.text import tall

    rows = spark.createDataFrame([(1, {"good": 1.0, "Bad": 2.0, "n": float("nan"), "i": float("-inf"), "none": None, "a.b_1": 3.0, "1st": 4.0}), (2, None), (3, {})], "k int, m map<string,double>")
    assert sorted(map(tuple, tall(rows, "k", "m").collect())) == [(1, "a.b_1", 3.0), (1, "good", 1.0)]


def test_a_batch_is_cut_in_slices():
    """A batch's texts don't lie in Python all at once; what comes out is as if they did."""
    most = 0

    def rows(part):
        nonlocal most
        most = max(most, part.stop - part.start)
        return [[str(i)] * (i % 3) for i in range(part.start, part.stop)]

    kind = pa.list_(pa.string())
    for n in (0, 1, textfns.SLICE, 1000):
        assert textfns.sliced(n, kind, rows).to_pylist() == [[str(i)] * (i % 3) for i in range(n)]
    assert most == textfns.SLICE
