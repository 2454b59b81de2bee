"""Text functions as columns, and the few that need Python as Arrow functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalized(text: str) -> str:
    """NFKC, lower case, without any white space: how texts are compared."""
    return "".join(unicodedata.normalize("NFKC", text).lower().split())


def normalized_with_map(text: str) -> tuple[str, list[int]] | None:
    """The normalised text and for each of its characters the place it comes from; None where normalising single
    characters gives something else than normalising the whole."""
    forms: dict[str, str] = {}
    out, places = [], []
    for i, c in enumerate(text):
        part = forms.get(c)
        if part is None:
            part = forms[c] = normalized(c)
        if part:
            out.append(part)
            places += (i,) * len(part)
    joined = "".join(out)
    return (joined, places) if joined == normalized(text) else None


@F.arrow_udf(T.StringType())
def norm_wide(texts: pa.Array) -> pa.Array:
    return pa.array((None if t is None else normalized(t) for t in texts.to_pylist()), pa.string())


def norm_for_match(text: Column | str) -> Column:
    """As normalized. Texts in ASCII, which NFKC leaves alone, are not sent to Python: it gets a null in their place."""
    t = F.col(text) if isinstance(text, str) else text
    plain = t.rlike(r"^[\x00-\x7f]*\z")
    return F.when(plain, F.regexp_replace(F.lower(t), r"[\t-\r\x1c- ]+", "")).otherwise(norm_wide(F.when(~plain, t)))


#: The line under a table's head.
RULE = re.compile(r"\|(\s*:?-{3,}:?\s*\|)+\s*")


def table_chunks(rows: list[str], size: int) -> list[str]:
    """A table's rows packed under its head, its first row and the rule below it, which every chunk repeats. A row is never
    cut, even if it is longer than size by itself."""
    top = 2 if len(rows) > 1 and RULE.fullmatch(rows[1]) else 1
    head = "\n".join(rows[:top])
    out, room = [], 0
    for row in rows[top:]:
        if not out or len(row) > room:
            out.append(head)
            room = size - len(head) - 1
        out[-1] += "\n" + row
        room -= len(row) + 1
    return out or [head]


def chunk_paragraphs(text: str, size: int = 600, overlap: int = 80) -> list[str]:
    """Paragraphs, between empty lines, packed into chunks of at most size; a longer one is cut by a sliding window, a table
    by rows. A chunk of prose after another begins with that one's last characters, so many as overlap says."""
    parts: list[tuple[bool, str]] = []  # whether prose that may grow, and the chunk
    prose: list[bool] = []
    for paragraph in filter(None, map(str.strip, re.split(r"\n\s*\n", text.strip()))):
        rows = paragraph.split("\n")
        if len(rows) > 1 and all(r.lstrip().startswith("|") for r in rows):
            new = [(False, c) for c in table_chunks([r.strip() for r in rows if r.strip()], size)]
        elif len(paragraph) > size:
            new = [(False, paragraph[i : i + size]) for i in range(0, len(paragraph), size - overlap)]
        elif parts and parts[-1][0] and len(parts[-1][1]) + 1 + len(paragraph) <= size:
            parts[-1] = (True, f"{parts[-1][1]}\n{paragraph}")
            continue
        else:
            new = [(True, paragraph)]
        parts += new
        prose += [not (len(rows) > 1 and rows[0].lstrip().startswith("|") and all(r.lstrip().startswith("|") for r in rows))] * len(new)
    chunks = [c for _, c in parts]
    joined = [chunks[i - 1][-overlap:] + c if i and overlap and prose[i] and prose[i - 1] else c for i, c in enumerate(chunks)]
    return [c.strip() for c in joined if c.strip()]


#: Rows of a batch whose texts are Python objects at a time.
SLICE = 64


def sliced(n: int, kind: pa.DataType, rows: Callable[[slice], Iterable]) -> pa.Array:
    """An array of n values that rows gives a few at a time, so that a batch's texts don't all lie in Python at once."""
    parts = [pa.array(rows(slice(i, min(n, i + SLICE))), kind) for i in range(0, n, SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(T.ArrayType(T.StringType()))
def chunk_text(texts: pa.Array) -> pa.Array:
    return sliced(len(texts), pa.list_(pa.string()), lambda s: [chunk_paragraphs(t or "") for t in texts[s].to_pylist()])


# The shortest quote that is looked for in normal form, and how long the beginnings are that stand for one.
SHORTEST, BEGINNINGS = 12, (48, 32, 20)


def places_of(text: str, parts: Iterable[str]) -> dict[str, tuple[int, int]]:
    """Where each of parts begins first in a text, and how often it stands there, overlaps included. All are looked for at
    once: one pass over the text, however many they are."""
    machine = ahocorasick.Automaton()
    for part in parts:
        if part:
            machine.add_word(part, part)
    found: dict[str, tuple[int, int]] = {}
    if len(machine):
        machine.make_automaton()
        for end, part in machine.iter(text):
            at, n = found.get(part, (end - len(part) + 1, 0))
            found[part] = (at, n + 1)
    return found


def anchors(text: str, quotes: list[str | None]) -> list[tuple[str, int, int] | None]:
    """How and where each quote stands in a text: as it is, in normal form, or by a beginning in normal form; None for one
    that doesn't or that does more than once. The text is searched twice at most: for all quotes, and in normal form for
    those that aren't there, with their beginnings."""
    exact = places_of(text, {q for q in quotes if q})
    wanted = {q: normalized(q) for q in quotes if q and q not in exact}
    forms = {q: [w, *(w[:n] for n in BEGINNINGS if n < len(w))] for q, w in wanted.items() if len(w) >= SHORTEST}
    mapped = normalized_with_map(text) if forms else None
    flat, places = mapped or ("", [])
    near = places_of(flat, {f for of in forms.values() for f in of})
    out: list[tuple[str, int, int] | None] = []
    for quote in quotes:
        found = None
        if quote in exact:
            at, n = exact[quote]
            found = ("exact", at, at + len(quote)) if n == 1 else None
        else:
            for k, part in enumerate(forms.get(quote, ())):
                if near.get(part, (0, 0))[1] == 1:
                    at = near[part][0]
                    found = ("prefix" if k else "normalized", places[at], places[at + len(part) - 1] + 1)
                    break
        out.append(found)
    return out


# What must be left of a chunk without its overlap, and how long the middle is that stands for one.
LEFT, MIDDLE = 40, 120


def chunk_anchors(text: str, chunks: list[str | None], overlap: int = 80) -> list[tuple[str, int, int, int] | None]:
    """How and where each chunk stands in the text that it was cut from: (how, start, stop, place in normal form), the first
    place if there are several. A chunk begins with the end of the one before, which the text doesn't have there, so that
    its rest is looked for, in normal form; if that isn't there, its middle is."""
    flats = [normalized(c) if c else "" for c in chunks]
    mapped = normalized_with_map(text) if any(flats) else None
    if mapped is None:
        return [None] * len(chunks)
    flat, places = mapped
    rests = [c[overlap:] if len(c) > overlap + LEFT else c for c in flats]
    middles = [c[(len(c) - MIDDLE) // 2 :][:MIDDLE] if len(c) > MIDDLE else "" for c in flats]
    found = places_of(flat, {*rests, *middles})
    out: list[tuple[str, int, int, int] | None] = []
    for rest, middle in zip(rests, middles):
        how, part = ("rest", rest) if rest in found else ("middle", middle)
        at = found[part][0] if part in found else None
        out.append(None if at is None else (how, places[at], places[at + len(part) - 1] + 1, at))
    return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("how", T.StringType())] + [T.StructField(n, T.IntegerType()) for n in ("start", "stop", "at")])))
def anchor_chunks(texts: pa.Array, chunks: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("how", pa.string()), *((n, pa.int32()) for n in ("start", "stop", "at"))]))
    none = {"how": None, "start": None, "stop": None, "at": None}
    told = lambda t, c: [dict(zip(none, f)) if f else none for f in chunk_anchors(t or "", c or [])]
    return sliced(len(texts), kind, lambda s: [told(t, c) for t, c in zip(texts[s].to_pylist(), chunks[s].to_pylist())])


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("tier", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))
def anchor_quotes(texts: pa.Array, quotes: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("tier", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    none = {"tier": None, "start": None, "stop": None}
    told = lambda t, q: [dict(zip(none, f)) if f else none for f in anchors(t or "", q or [])]
    return sliced(len(texts), kind, lambda s: [told(t, q) for t, q in zip(texts[s].to_pylist(), quotes[s].to_pylist())])


# CJK characters between which a gap closes, those that the token estimate counts, garbled ones.
CJK = r"[\x{4E00}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
CJK_TOKENS = r"[\x{2E80}-\x{2FDF}\x{3000}-\x{312F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
GARBLED = r"[\x{E000}-\x{F8FF}\x{FFFD}]"


def _squeezed(text: Column) -> Column:
    """Gaps between CJK characters closed, other runs of blanks one blank."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?U)(?<={CJK})\s+(?={CJK})", ""), r"[ \t]{2,}", " ")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def clean_text(text: Column) -> Column:
    """For passages: as squeezed, and lines joined by blanks; idempotent."""
    return _stripped(F.regexp_replace(_squeezed(text), r"(?U)\s*\n\s*", " "))


def clean_extracted(text: Column) -> Column:
    """For storing: no NUL; paragraphs, between empty lines, squeezed one by one; empty ones go, borders stay."""
    paragraphs = F.filter(F.split(F.replace(text, F.lit("\0"), F.lit("")), r"(?U)\n\s*\n"), lambda p: p.rlike(r"(?U)\S"))
    return F.array_join(F.transform(paragraphs, lambda p: _stripped(_squeezed(p))), "\n\n")


def terms_of(phrase: Column) -> Column:
    """Distinct runs of Latin letters and digits, or of CJK characters, of a text in normal form, in order."""
    return F.array_distinct(F.regexp_extract_all(phrase, F.lit(r"[a-z0-9]+|[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]+"), F.lit(0)))


def weighted(*terms: tuple[float, Column]) -> Column:
    """Mean of values by weight; one that is null lends its weight to the others."""
    total = sum((F.coalesce(w * v, F.lit(0.0)) for w, v in terms), F.lit(0.0))
    return total / sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for w, v in terms), F.lit(0.0))


def script_language(text: Column) -> Column:
    """zh, en, mixed or unknown by counts of CJK and Latin characters; one of them must be twice the other."""
    cjk, latin = F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]")), F.regexp_count(text, F.lit(r"[A-Za-z]"))
    return F.when((cjk == 0) & (latin == 0), "unknown").when(cjk >= 2 * latin, "zh").when(latin >= 2 * cjk, "en").otherwise("mixed")


def encodes(char: str, codec: str) -> bool:
    try:
        char.encode(codec)
    except UnicodeEncodeError:
        return False
    return True


#: Characters of the simplified script alone: the national standard of the one script has them, that of the other hasn't.
SIMPLIFIED = "".join(c for c in map(chr, range(0x4E00, 0xA000)) if encodes(c, "gb2312") and not encodes(c, "big5"))
# How many of them, and what share of the CJK characters, make a text one of that script.
FEWEST, SHARE = 2, 0.05


def simplified_count(text: Column) -> Column:
    """How many characters of the simplified script alone a text has."""
    return F.length(text) - F.length(F.translate(text, SIMPLIFIED, ""))


def looks_simplified(text: Column) -> Column:
    """Whether a text is in the simplified script: by number, so that a name in it doesn't count, and by share, so that two
    names in a long text don't."""
    han = F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    n = simplified_count(text)
    return F.coalesce((n >= FEWEST) & (n >= SHARE * han), F.lit(False))


def garbled_ratio(text: Column) -> Column:
    """Share of private-use and replacement characters."""
    n = F.length(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(GARBLED)) / n).otherwise(F.lit(0.0))


def token_estimate(text: Column) -> Column:
    """0.8 tokens a CJK character, 3.5 other characters a token, blanks none; halves go to the even side."""
    cjk = F.regexp_count(text, F.lit(CJK_TOKENS))
    other = F.greatest(F.length(text) - cjk - F.regexp_count(text, F.lit(r"(?U)\s")), F.lit(0))
    return F.bround(cjk * 0.8 + other / 3.5, 0).cast("long")


def register(spark: SparkSession) -> None:
    """Makes the Python functions callable from SQL."""
    for name, f in (("norm_for_match", norm_wide), ("chunk_text", chunk_text), ("anchor_quotes", anchor_quotes), ("anchor_chunks", anchor_chunks)):
        spark.udf.register(name, f)
