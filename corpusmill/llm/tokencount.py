"""Token counts (operator 8): a byte-level BPE tokenizer compiled to finite-state transducers.

Two deterministic transducers run one after the other, and neither builds token ids.

1. The splitter reads classes of code points and marks where a match of the split pattern begins; a mark may lie one
   character back, where the pattern looks ahead. A chunk of text maps each state it may be entered in to the state it
   is left in; these maps compose, so numpy runs all chunks of a batch side by side for all entry states, composes the
   maps by a parallel prefix scan, and then knows each chunk's own entry state.
2. The counter reads the bytes of one match and annotates each transition with how many tokens the prefix gained. A
   prefix ends in exactly one token that fits the token before it, namely one that the merges leave beside it, so a
   state is what the next byte can depend on: for each start of a token that may still go on, its place in the
   vocabulary's trie, the token before it, and the count there. Transitions are compiled when first met and kept up to
   a bound; a match's total is a sum of annotations. At a match's begin the counter is in its start state, whatever came
   before, so that the state map of a chunk of whole matches is one number, its count; these maps compose by addition,
   and the prefix scan over them is a running sum, from which each text reads its total at its two ends.

The added special token of the tokenizer file, where its string occurs in a text, is one token, as is the library's
default; nothing is truncated or padded. Nulls count as empty texts of no token. Repeated rows are counted alike. Long
texts are cut only where a match always begins. Empty tables give no rows; columns but doc_id and text are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_udf

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Code points of a batch, about, and of a chunk.
BATCH, CHUNK = 1 << 20, 64

# Classes of code points; those from S on are letters that a contraction may hold.
SEP, LETTER, NUMBER, BLANK, SPACE, OTHER, QUOTE, S, R, V, L, E = range(12)
# States: between matches; in a run of letters, numbers, others; one blank, one other space, and runs of two or more
# spaces that end in either; a quote that begins a match, alone or with r, v, l behind it.
START, WORD, DIGITS, MARKS, ONE_BLANK, ONE_SPACE, BLANKS, SPACES, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
#: Output: a match begins here, or one character back.
HERE, BACK = 1, 2


def _classes() -> np.ndarray:
    of = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            of[c] = LETTER if kind == "L" else NUMBER
    for c in [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        of[c] = SPACE
    for c, k in ((" ", BLANK), ("'", QUOTE), ("s", S), ("t", S), ("m", S), ("d", S), ("r", R), ("v", V), ("l", L), ("e", E)):
        of[ord(c)] = k
    return of


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output of each state and class."""
    to, out = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    letters = {LETTER, S, R, V, L, E}
    runs = {WORD: letters, DIGITS: {NUMBER}, MARKS: {OTHER, QUOTE}}
    fresh = {k: WORD for k in letters} | {SEP: START, NUMBER: DIGITS, BLANK: ONE_BLANK, SPACE: ONE_SPACE, OTHER: MARKS, QUOTE: QUOTED}
    joined = {k: WORD for k in letters} | {NUMBER: DIGITS, OTHER: MARKS, QUOTE: MARKS}  # what a blank in front goes with
    for k in range(12):
        for state in range(12):
            to[state, k], out[state, k] = fresh[k], HERE
        for state, own in runs.items():
            if k in own:
                to[state, k], out[state, k] = state, 0
        if k in joined:
            to[ONE_BLANK, k], out[ONE_BLANK, k] = joined[k], 0
            to[BLANKS, k], out[BLANKS, k] = joined[k], BACK
            out[SPACES, k] = HERE | BACK
        if k in (BLANK, SPACE):
            for state in (ONE_BLANK, ONE_SPACE, BLANKS, SPACES):
                to[state, k], out[state, k] = (BLANKS if k == BLANK else SPACES), 0
        for state in (QUOTED_R, QUOTED_V, QUOTED_L):  # no contraction: the quote stands alone, a word goes on
            to[state, k], out[state, k] = (WORD, BACK) if k in letters else (fresh[k], HERE | BACK)
    for k, state in ((S, START), (R, QUOTED_R), (V, QUOTED_V), (L, QUOTED_L), (OTHER, MARKS), (QUOTE, MARKS)):
        to[QUOTED, k], out[QUOTED, k] = state, 0
    for state, k in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)):
        to[state, k], out[state, k] = START, 0
    return to, out


def begins(classes: np.ndarray, to: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Whether a match begins at each position; classes starts and ends with SEP."""
    n = len(classes)
    chunks = -(-n // CHUNK)
    grid = np.zeros(chunks * CHUNK, np.intp)
    grid[:n] = classes
    columns = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    flat, marks = to.ravel(), out.ravel()
    maps = np.tile(np.arange(12, dtype=np.intp), (chunks, 1))
    for column in columns:
        maps = flat[maps * 12 + column[:, None]].astype(np.intp)
    step = 1
    while step < chunks:  # prefix scan: after a round, a map covers twice as many chunks
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    state = np.concatenate(([START], maps[:-1, START]))
    found = np.empty((CHUNK, chunks), np.uint8)
    for j, column in enumerate(columns):
        at = state * 12 + column
        found[j] = marks[at]
        state = flat[at].astype(np.intp)
    found = found.T.ravel()[:n]
    begin = (found & HERE).astype(bool)
    begin[:-1] |= (found[1:] & BACK).astype(bool)
    return begin


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger(dict):
    """Token count of a match by the second transducer; itself the bounded memory of counts by match."""

    def __init__(self, path: str, room: int = 300_000, states: int = 150_000):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file["model"]["type"] != "BPE" or file["pre_tokenizer"]["type"] != "ByteLevel" or file.get("normalizer"):
            raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
        split = file["pre_tokenizer"]
        if file["model"].get("ignore_merges") or split.get("add_prefix_space") or not split.get("use_regex", True) or any(not t["special"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in file["added_tokens"]):
            raise ValueError("merges must hold, texts get no blank in front, the usual pattern splits, and added tokens are plain special ones")
        byte = byte_letters()
        raw = lambda token: bytes(byte[c] for c in token)
        self.special = [t["content"] for t in file["added_tokens"] if t["special"]]
        added = set(self.special)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.room, self.most = room, states
        self.trie: dict[int, int] = {}
        self.token: list[bytes | None] = [None]
        self.inner: list[bool] = [False]
        for token in (raw(t) for t in file["model"]["vocab"] if t not in added):
            node = 0
            for b in token:
                self.inner[node] = True
                key = node << 8 | b
                if key not in self.trie:
                    self.trie[key] = len(self.token)
                    self.token.append(None)
                    self.inner.append(False)
                node = self.trie[key]
            self.token[node] = token
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.forget()

    def forget(self) -> None:
        first = ((0, b"", 0),)
        self.states, self.number, self.moves = [first], {first: 0}, {}

    def stays(self, a: bytes, b: bytes) -> bool:
        """Whether the merges of a + b end in just a, b (of b in just b, if a is empty)."""
        if (known := self.fits.get((a, b))) is None:
            parts, ranks = [bytes((x,)) for x in a + b], self.ranks
            while len(parts) > 1:
                r, i = min((ranks.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
                if r == 1 << 30:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(self.fits) >= 300_000:
                self.fits.clear()
            known = self.fits[a, b] = parts == ([a, b] if a else [b])
        return known

    def compiled(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and gained tokens of a transition met for the first time."""
        live, last, gain = [], b"", None
        for node, before, count in self.states[state]:  # longest token first
            child = self.trie.get(node << 8 | byte)
            if child is None:
                continue
            token = self.token[child]
            if gain is None and token is not None and self.stays(before, token):
                last, gain = token, count + 1
            if self.inner[child]:
                live.append((child, before, count))
        after = (*((c, b, n - gain) for c, b, n in live), (0, last, 0))
        new = self.number.setdefault(after, len(self.states))
        if new == len(self.states):
            self.states.append(after)
        self.moves[state << 8 | byte] = (new, gain)
        return new, gain

    def __missing__(self, piece: str) -> int:
        if len(self.states) > self.most:
            self.forget()
        state = total = 0
        for byte in piece.encode("utf-8", "surrogatepass"):
            state, gain = self.moves.get(state << 8 | byte) or self.compiled(state, byte)
            total += gain
        if len(piece) < 64:
            if len(self) >= self.room:
                self.clear()
            self[piece] = total
        return total


class Counter:
    """Counts tokens of texts, batch by batch."""

    def __init__(self, path: str):
        self.merger, self.classes, (self.to, self.out) = Merger(path), _classes(), _splitter()

    def parts(self, text: str) -> Iterator[str]:
        """What stands between special tokens, cut further where a space follows a character that is none: there a
        match always begins, so parts can be counted apart."""
        segments = [text]
        for special in self.merger.special:
            segments = [y for x in segments for y in x.split(special)]
        for segment in segments:
            start = 0
            while len(segment) - start > BATCH:
                cut = segment.find(" ", start + BATCH)
                while cut > 0 and segment[cut - 1].isspace():
                    cut = segment.find(" ", cut + 1)
                if cut < 0:
                    break
                yield segment[start:cut]
                start = cut
            yield segment[start:]

    def batch(self, parts: list[str], owners: list[int], totals: np.ndarray) -> None:
        joined = " " + " ".join(parts) + " "
        classes = self.classes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        gaps = np.cumsum([0, *(len(p) + 1 for p in parts)])
        classes[gaps] = SEP
        starts = np.flatnonzero(begins(classes, self.to, self.out))
        cuts = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(cuts, [*cuts[1:], len(joined)])]
        counts = np.fromiter(map(self.merger.__getitem__, pieces), np.int64, len(pieces))
        sums = np.concatenate(([0], np.cumsum(np.where(classes[starts] == SEP, 0, counts))))
        np.add.at(totals, owners, np.diff(sums[np.searchsorted(starts, gaps)]))

    def count(self, texts: list[str | None]) -> np.ndarray:
        totals = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owners: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            totals[i] = sum(text.count(s) for s in self.merger.special)
            for part in self.parts(text):
                parts.append(part)
                owners.append(i)
                held += len(part) + 1
                if held > BATCH:
                    self.batch(parts, owners, totals)
                    parts, owners, held = [], [], 0
        if parts:
            self.batch(parts, owners, totals)
        return totals


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each Python worker and tokenizer file."""
    return Counter(path)


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """How many tokens each text has, long."""

    @text_udf("long")
    def count_tokens(texts: pa.Array) -> pa.Array:
        return pa.array(counter(path).count(texts.to_pylist()))

    return count_tokens(text)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether they pass 512 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), token_count(F.col("text")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
