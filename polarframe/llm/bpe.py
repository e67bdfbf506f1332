"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece of text exactly one token can be the last of its encoding. An automaton over all token
byte strings (failure links lead to the next shorter suffix) lists the tokens that end at each place; a token is the
right one if it is the whole prefix, or if it is compatible with the last token of the prefix before it. The pair test
undoes merges at the seam until no merge of higher priority could cross it. The back-pointers from the end give the
exact ids, without ever running merges.

Pieces come from the vocabulary's splitting pattern. A worker keeps the ids of up to ``KEPT_PIECES`` pieces; beyond
that it starts anew, so memory is bounded and results never change. Null texts encode as empty ones. Every row is
encoded by itself: no shuffle, and hot sources or copies make no difference.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarframe.llm.tokens import PATTERN, vocabulary

KEPT_PIECES = 400_000
LONGEST_KEPT = 64


class Pieces(dict):
    """Ids (little-endian 32 bit) by piece; a missing piece is encoded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class PrefixEncoder:
    def __init__(self, path: str):
        tokens, merges, self.special = vocabulary(path)
        self.text_of = {i: t for t, i in tokens.items()} | {i: s.encode() for s, i in self.special.items()}
        size = {i: len(t) for t, i in tokens.items()}
        self.pair = {(a, b): tokens[self.text_of[a] + self.text_of[b]] for a, b in merges}
        self.halves = {i: (i, i) for i in size} | {whole: ab for ab, whole in self.pair.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in tokens.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.size = size
        self.known: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self.encode_piece)
        self.split = regex.compile(PATTERN).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of both tokens gives just these two; ids grow as merge priority falls."""
        seam, bound = (left, right), 1 << 40
        while True:
            joined = self.pair.get((left, right))
            if joined is not None and joined < bound:
                break
            # The later merge of the two sides is undone first; an earlier one across the seam would have won.
            if left > right:
                bound = left
                inner = self.halves[left][1]
                if inner != left:
                    left = inner
                    continue
                bound = right + 1
                inner = self.halves[right][0]
                if inner == right:
                    return self._keep(seam, True)
                right = inner
            else:
                bound = right + 1
                inner = self.halves[right][0]
                if inner != right:
                    right = inner
                    continue
                bound = left
                inner = self.halves[left][1]
                if inner == left:
                    return self._keep(seam, True)
                left = inner
        return self._keep(seam, False)

    def _keep(self, seam: tuple[int, int], fits: bool) -> bool:
        if len(self.known) >= 4 * KEPT_PIECES:
            self.known.clear()
        self.known[seam] = fits
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        last: list[int | None] = [None] * (len(piece) + 1)
        known, compatible = self.known, self.compatible
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] is not None:
                continue
            if size == end:
                last[end] = token
                continue
            before = last[end - size]
            if before is None:
                continue
            fits = known.get((before, token))
            if compatible(before, token) if fits is None else fits:
                last[end] = token
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= self.size[last[at]]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers; strings of special tokens become those tokens."""
        kept = self.pieces.__getitem__
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(kept, self.split(text)))
        return b"".join(
            np.array([self.special[part]], "<u4").tobytes() if part in self.special else b"".join(map(kept, self.split(part)))
            for part in self.cut(text)
        )

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def prefix_encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def _per_text(docs: DataFrame, tokenizer: str, make, schema: str, types: list[pa.DataType]) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(tokenizer)
        for batch in batches:
            rows = [make(encoder, encoder.encode(t.as_py() or "")) for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def encode_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text."""
    return _per_text(docs, tokenizer, lambda _, ids: (np.frombuffer(ids, "<u4").astype(np.int32),), "doc_id bigint, ids array<int>", [pa.list_(pa.int32())])


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text encoded and decoded again."""

    def digest(encoder: PrefixEncoder, ids: bytes):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(encoder.decode(ids).encode("utf-8")).hexdigest()

    return _per_text(docs, tokenizer, digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()])


def decode_ids(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(tokenizer)
        for batch in batches:
            texts = [encoder.decode(np.array(ids.as_py() or [], "<u4").tobytes()) for ids in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint"), "ids").mapInArrow(run, "doc_id bigint, text string")
