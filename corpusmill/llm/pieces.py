"""SentencePiece encoding and decoding (operator 11).

A text is marked (one marker before it, one for each space) and cut before each run of markers. No piece of the
vocabulary goes on over such a cut, so that merges of one marked word never touch another's: the distinct marked words
enter a table, each is segmented once, and its ids are joined back to every position where it stands. A worker's table
goes on from text to text in two generations, of which the older goes when the younger is full; that bounds memory and
nothing else.

Nulls count as empty texts, which have no tokens and decode to the empty text. Repeated rows are encoded alike. Long
texts are encoded whole; a single marked word of n characters takes n log n. Empty tables give no rows; other columns
than doc_id and text are not read.
"""

from __future__ import annotations

import codecs
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_udf

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: A marked word: a run of markers and what follows it.
MARKED = re.compile(f"{MARK}+[^{MARK}]*")
#: What a model's normaliser must leave as it is; all else would need its tables.
PLAIN = ("ﬁ ①  a", "é　 \tx ")

#: The score of a pair that is no piece.
NEVER = float("inf")

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class Pieces:
    """The vocabulary of a model file and the table of marked words with their ids."""

    def __init__(self, path: str, words: int = 200_000, chars: int = 8_000_000):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        odd = [model.is_control(i) or model.is_unknown(i) for i in range(len(names))]
        byte = [model.is_byte(i) for i in range(len(names))]
        self.ids = {p: i for i, p in enumerate(names) if not odd[i] and not byte[i]}
        self.scores = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(names[i][3:5], 16): i for i in range(len(names)) if byte[i]}
        crossing = [p for p in self.ids if MARK in p.lstrip(MARK)]
        if crossing or len(self.bytes) < 256 or [model.normalize(t) for t in PLAIN] != [MARK + t.replace(" ", MARK) for t in PLAIN]:
            raise ValueError(f"{path}: needs pieces that end before markers, all bytes, and a plain normaliser")
        surfaces = [bytes([int(p[3:5], 16)]) if b else p.replace(MARK, " ").encode() for p, b in zip(names, byte)]
        for i in range(len(names)):
            surfaces[i] = (" ⁇ ".encode() if model.is_unknown(i) else b"") if odd[i] else surfaces[i]
        self.surfaces = pa.array(surfaces, pa.large_binary())
        self.silent = np.array([s == b"" for s in surfaces])
        self.marked = np.array([p.startswith(MARK) for p in names])
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words, self.chars, self.held = words, chars, 0

    def segment(self, word: str) -> list[int]:
        """Ids of one marked word: while two neighbours form a piece, those of the best score (the leftmost of equals)
        become it; what is no piece in the end is spelt in bytes."""
        parts = list(word)
        parts = self.few(parts) if len(parts) <= 48 else self.many(parts)
        ids: list[int] = []
        for part in parts:
            known = self.ids.get(part)
            ids.extend([known] if known is not None else map(self.bytes.__getitem__, part.encode()))
        return ids

    def few(self, parts: list[str]) -> list[str]:
        """The merges of a short word: the list of its pairs' scores is searched anew each time."""
        get = self.scores.get
        pairs = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < NEVER:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        return parts

    def many(self, parts: list[str]) -> list[str]:
        """The merges of a long word, by a queue of pairs; pairs that a merge has changed are passed over."""
        n, scores = len(parts), self.scores
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(scores[s], i, s) for i, s in enumerate(map(str.__add__, parts, parts[1:])) if s in scores]
        heapify(queue)
        while queue:
            _, i, whole = heappop(queue)
            k = after[i]
            if k >= n or not parts[i] or parts[i] + parts[k] != whole:
                continue
            parts[i], parts[k] = whole, ""
            k = after[i] = after[k]
            if k < n:
                before[k] = i
                if (s := whole + parts[k]) in scores:
                    heappush(queue, (scores[s], i, s))
            if (j := before[i]) >= 0 and (s := parts[j] + whole) in scores:
                heappush(queue, (scores[s], j, s))
        return [p for p in parts if p]

    def marked_words(self, text: str) -> list[str]:
        """The marked words of a text in their order; they join to the marked text."""
        return MARKED.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit integers."""
        words = self.marked_words(text or "")
        for word in [w for w in set(words) if w not in self.table]:
            self.table[word] = self.older.get(word) or np.array(self.segment(word), np.int32).tobytes()
            self.held += len(word)
        ids = b"".join(map(self.table.__getitem__, words))
        if len(self.table) > self.words or self.held > self.chars:
            self.older, self.table, self.held = self.table, {}, 0
        return ids

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Lists of ids, one for each text."""
        ids = [self.encode(t.as_py()) for t in texts]
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))

    def decode_all(self, lists: pa.Array) -> pa.Array:
        """The text of each list of ids, null for null: pieces with spaces for markers, but for one marker at the very
        beginning; nothing for control ids; bytes that are no character, one by one, as U+FFFD."""
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        parts = self.surfaces.take(pa.array(ids))
        where = np.frombuffer(parts.buffers()[1], np.int64)[: len(parts) + 1]
        data = memoryview(parts.buffers()[2] or b"")
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)])
        quiet = np.flatnonzero(self.silent[ids])  # bytes on two sides of a control id are no character
        texts = []
        for valid, a, b in zip(lists.is_valid().to_pylist(), ends.tolist(), ends[1:].tolist()):
            cuts = [a, *quiet[np.searchsorted(quiet, a) : np.searchsorted(quiet, b)].tolist(), b]
            first = next((i for i in range(a, b) if not self.silent[ids[i]]), b)
            at = where[cuts].tolist()
            spans = [str(data[x:y], "utf-8", "each_byte") for x, y in zip(at, at[1:])]
            text = "".join(spans)
            texts.append((text[1:] if first < b and self.marked[ids[first]] else text) if valid else None)
        return pa.array(texts, pa.string())


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One table for each Python worker and model file; it lives as long as the worker."""
    return Pieces(path)


def encoded(text: Column, path: str = MODEL) -> Column:
    """Ids of each text, array<int>."""

    @text_udf("array<int>")
    def encode_pieces(texts: pa.Array) -> pa.Array:
        return pieces(path).encode_all(texts)

    return encode_pieces(text)


def decoded(ids: Column, path: str = MODEL) -> Column:
    """The text that ids stand for, string."""

    @text_udf("string")
    def decode_pieces(lists: pa.Array) -> pa.Array:
        return pieces(path).decode_all(lists)

    return decode_pieces(ids)


def encode_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, token_ids (array<int>, empty for null and empty texts); other columns of docs are not read."""
    return docs.select("doc_id", encoded(F.col("text"), path).alias("token_ids"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document, decodes the ids again and digests both."""
    ids = encode_documents(table(spark, sf_dir, "documents")).withColumn("decoded", decoded(F.col("token_ids")))
    return ids.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
