"""Byte-level BPE encoding and decoding (operator 2).

A text is cut by the split pattern of the rank file; the bytes of each match are merged with a segment tree whose
leaves are byte positions and whose root is the leftmost pair of least rank. A merge takes point updates of the live
neighbours, each of logarithmic cost, so that a match of n bytes costs n log n, however long it is.

Nulls count as empty texts, which have no tokens and decode to no bytes. Repeated rows are encoded alike. Long texts are
encoded whole, block by block of matches. Empty tables give no rows; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_udf

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: White space as Unicode's White_Space property has it; Python's own \s has four controls more.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Numbers that are no decimal digits; \w less digits, these and _ is \p{L}.
NUMBERS = "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha())
#: Any of them, or any character beyond the basic plane: those few make a class slow to test, so they go together.
ODD = re.compile(f"[{''.join(c for c in NUMBERS if c <= chr(0xFFFF))}{chr(0x10000)}-{chr(0x10FFFF)}]")


def splitter(numbers: str) -> re.Pattern[str]:
    """public_tokenizers.PATTERN for the standard library's re, which is faster than regex: its three classes written
    out, and the contractions tried after words and numbers, which cannot begin with their apostrophe."""
    return re.compile(
        rf" ?[^\W\d_{numbers}]+| ?[\d{numbers}]+|'(?:[stmd]|re|ve|ll)| ?(?:_|[^{SPACE}\w])+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


#: For any text, and for texts without a character of NUMBERS, which are nearly all and split faster so.
PIECE, PLAIN = splitter(NUMBERS), splitter("")
#: Children of a node of the segment tree; the rank of no pair, and what leaves without a pair compare with.
FAN, NONE = 16, 1 << 30
NEVER = NONE << 32


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match: while a pair of neighbours is a token, the leftmost one of least rank becomes it.

    levels[0] has a leaf for each byte position, the rank of the pair that begins there with its position behind it, so
    that ties go to the left; a node of a level above is the least of FAN below it. The root is the least at the top."""
    if piece in ranks:
        return [ranks[piece]]
    n, get = len(piece), ranks.get
    leaves = [get(piece[i : i + 2], NONE) << 32 | i for i in range(n - 1)]
    levels = [leaves]
    while len(levels[-1]) > FAN:
        levels.append([min(levels[-1][k : k + FAN]) for k in range(0, len(levels[-1]), FAN)])
    top, deep = levels[-1], len(levels) > 1
    after, before = list(range(1, n + 2)), list(range(-1, n))
    while (least := min(top)) < NEVER:
        i = least & 0xFFFFFFFF
        gone, prev = after[i], before[i]
        end = after[i] = after[gone]
        before[end] = i
        leaves[i] = get(piece[i : after[end]], NONE) << 32 | i if end < n else NEVER
        if gone < n - 1:
            leaves[gone] = NEVER
        if prev >= 0:
            leaves[prev] = get(piece[prev:end], NONE) << 32 | prev
        if deep:  # the paths of the three leaves; they soon meet
            paths = {i // FAN, min(gone, n - 2) // FAN, max(prev, 0) // FAN}
            for below, level in zip(levels, levels[1:]):
                for k in paths:
                    level[k] = min(below[k * FAN : (k + 1) * FAN])
                paths = {k // FAN for k in paths}
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Encoder(dict):
    """Maps a match of PIECE to its token ids as 32-bit integers in bytes. It remembers at most twice `room` matches, in
    two generations, of which the older goes when the younger is full; that bounds memory and nothing else."""

    def __init__(self, path: str, room: int = 150_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.room = room
        self.older: dict[str, bytes] = {}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            tokens[i] = token
        self.tokens = pa.array(tokens, pa.large_binary())

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece) or np.array(merged(piece.encode(), self.ranks), np.int32).tobytes()
        if len(piece) < 64:
            if len(self) >= self.room:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str | None, block: int = 1 << 20) -> bytes:
        """Token ids of a text; in a long one, blocks of matches bound what is held besides the ids."""
        if not text:
            return b""
        pattern = PLAIN if text.isascii() or not ODD.search(text) else PIECE
        if len(text) <= block:
            return b"".join(map(self.__getitem__, pattern.findall(text)))
        pieces: Iterator[str] = (m[0] for m in pattern.finditer(text))
        ids = bytearray()
        while some := list(islice(pieces, 1 << 16)):
            ids += b"".join(map(self.__getitem__, some))
        return bytes(ids)

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Lists of token ids, one for each text."""
        ids = [self.encode(t.as_py()) for t in texts]
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))

    def decode_all(self, lists: pa.Array) -> pa.Array:
        """The bytes that each list of ids stands for; null for null."""
        ids = lists.flatten()
        parts = self.tokens.take(ids)
        where = np.frombuffer(parts.buffers()[1], np.int64)[: len(parts) + 1]
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = where[np.cumsum([0, *lengths])]
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends), parts.buffers()[2]])
        return whole if not lists.null_count else pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.large_binary()))

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and rank file; it lives as long as the worker."""
    return Encoder(path)


def encoded(text: Column, path: str = RANKS) -> Column:
    """Token ids of each text, array<int>."""

    @text_udf("array<int>")
    def encode_bpe(texts: pa.Array) -> pa.Array:
        return encoder(path).encode_all(texts)

    return encode_bpe(text)


def decoded(ids: Column, path: str = RANKS) -> Column:
    """The bytes that token ids stand for, binary; a list need not end where a character does."""

    @text_udf("binary")
    def decode_bpe(lists: pa.Array) -> pa.Array:
        return encoder(path).decode_all(lists).cast(pa.binary())

    return decode_bpe(ids)


def encode_documents(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, token_ids (array<int>, empty for null and empty texts); other columns of docs are not read."""
    return docs.select("doc_id", encoded(F.col("text"), path).alias("token_ids"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document, decodes the ids again and digests both."""
    ids = encode_documents(table(spark, sf_dir, "documents")).withColumn("decoded", decoded(F.col("token_ids")))
    return ids.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
