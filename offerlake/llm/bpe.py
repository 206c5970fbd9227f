"""Byte-level BPE: encoding by longest matches with backtracking, and decoding.

A split of a word into tokens is the one that merging by rank gives exactly if every token, and every pair of
neighbours, is what merging gives for its own bytes. So a word is walked from the left with the longest token that
is compatible with its left neighbour; where none is, the last token is taken back and that place is not entered
again. Each place fails at most once, which keeps the walk linear in the word's bytes. The tokens that begin at each
place come from one Aho-Corasick pass over the bytes mapped to Latin-1; whether two tokens may stand side by side is
computed by merging their bytes once and remembered.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, slices, texts

#: Bytes of words and their ids that a worker remembers from lately, and as many from before; and pairs of tokens.
WORD_BYTES, PAIRS = 4 << 20, 200_000


class _Words(dict):
    """Word -> packed ids, filled as words come up. Words that come up again outlive the others."""

    def __init__(self, encode):
        super().__init__()
        self._encode, self._before, self._bytes = encode, {}, 0

    def clear(self) -> None:
        super().clear()
        self._before, self._bytes = {}, 0

    def __missing__(self, word: str) -> bytes:
        if self._bytes >= WORD_BYTES:
            self._before, self._bytes = dict(self), 0
            super().clear()
        if (out := self._before.get(word)) is None:
            ids = self._encode(word.encode("utf-8", "surrogatepass"))
            out = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = out
        self._bytes += len(word) + len(out)
        return out


class Codec:
    """Encoder and decoder for one table of ranks (bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.compatible: dict[tuple[bytes, bytes], bool] = {}
        self.words = _Words(self.encode_word)

    @cached_property
    def matcher(self) -> ahocorasick.Automaton:
        matcher = ahocorasick.Automaton()
        for token in self.ranks:
            if self.merged(token) == [token]:  # others come up only as a whole word
                matcher.add_word(token.decode("latin-1"), (len(token) - 1, token))
        matcher.make_automaton()
        return matcher

    def merged(self, data: bytes) -> list[bytes]:
        """The definition: merge the neighbours of lowest rank until none can be."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        pair = (left, right)
        if (known := self.compatible.get(pair)) is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            known = self.compatible[pair] = self.merged(left + right) == [left, right]
        return known

    def encode_word(self, word: bytes) -> list[int]:
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        # each place's longest token, which the walk below tries first, is mostly right all along
        longest = [token for _, (_, token) in self.matcher.iter_long(word.decode("latin-1"))]
        if all(map(self.fits, longest, longest[1:])):
            return [self.ranks[t] for t in longest]
        starting: list[list[bytes]] = [[] for _ in word]
        for end, (size, token) in self.matcher.iter(word.decode("latin-1")):
            starting[end - size].append(token)  # ends ascend, so the longest is last
        open_at = [True] * (len(word) + 1)
        tokens: list[bytes] = []
        at, tried = 0, []  # tried: for each token placed, how many choices are left at its place
        left = len(starting[0])
        while at < len(word):
            choices, placed = starting[at], False
            while left:
                left -= 1
                token = choices[left]
                if open_at[at + len(token)] and (not tokens or self.fits(tokens[-1], token)):
                    tokens.append(token)
                    tried.append(left)
                    at += len(token)
                    left = len(starting[at]) if at < len(word) else 0
                    placed = True
                    break
            if not placed:
                open_at[at] = False
                at -= len(tokens.pop())
                left = tried.pop()
        return [self.ranks[t] for t in tokens]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Codec(ranks, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, decoded: bool = False) -> DataFrame:
    """One row (doc_id, ids, n_tokens) for each row of docs (doc_id, text).

    ids is binary: little-endian unsigned 32-bit integers, the layout that training loaders map into memory. With
    decoded, the ids are also decoded again, in the same pass over the data, into a column of that name. vocabulary names a file of base64 tokens and ranks that every executor has. Null and empty texts give no ids;
    repeated rows are encoded each for itself; other columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        with freed(own.words, own.compatible):
            for batch in slices(batches, limit=4 << 20):
                ids = [own.encode(t) for t in batch.column("text").to_pylist()]
                made = {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                if decoded:
                    made["decoded"] = pa.array(map(own.decode, ids), pa.binary())
                yield pa.RecordBatch.from_pydict(made)

    return texts(docs).mapInArrow(run, "doc_id long, ids binary, n_tokens long" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """encoded (with a column ids as from encode()) plus decoded, the bytes that the ids stand for; null ids give null."""

    @F.arrow_udf("binary")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(vocabulary, pattern)
        for ids in parts:
            yield pa.array([None if x is None else own.decode(x) for x in ids.to_pylist()], pa.binary())

    return encoded.withColumn("decoded", run("ids"))
