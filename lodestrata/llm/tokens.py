"""Byte-pair encoding of texts with a public vocabulary, in numpy matrices.

Texts are cut into words by the vocabulary's pattern; the distinct words of a batch are bucketed by byte length into padded
matrices. Each round every row merges its leftmost pair of least rank, found through a hash table of pairs, and the matrix is
compacted; rows without a mergeable pair leave. Very long words are rows of their own that merge all their disjoint pairs of least rank in a
round, which gives the same ids, as a merged token is only ever part of tokens of greater rank. Words once encoded are kept in a bounded cache.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public vocabulary's own word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GONE = np.int32(-1)
_NEVER = np.int32(2**31 - 1)
_CACHE_WORDS = 400_000
#: Bytes from which a word is merged by itself.
LONG = 512


class Vocabulary:
    """Ranks of a byte-level vocabulary, with an open-addressing table of mergeable pairs."""

    _loaded: dict[str, Vocabulary] = {}

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(8, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, _NEVER, np.int32)
        waiting, slots, values = keys, self._slot(keys), np.array(rank, np.int32)
        self.probes = 0
        while len(waiting):
            self.probes += 1
            free = self.keys[slots] == np.uint64(2**64 - 1)
            self.keys[slots[free]] = waiting[free]
            mine = self.keys[slots] == waiting
            self.ranks[slots[mine]] = values[mine]
            waiting, slots, values = waiting[~mine], (slots[~mine] + 1) & ((1 << self.bits) - 1), values[~mine]
        self.cache: dict[str, np.ndarray] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path, PATTERN)
        return cls._loaded[path]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that a pair of ids merges into, or the largest integer."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slots = self._slot(keys)
        out = np.where(self.keys[slots] == keys, self.ranks[slots], _NEVER)
        open_ = (out == _NEVER) & (self.keys[slots] != np.uint64(2**64 - 1))
        for _ in range(self.probes - 1):
            if not open_.any():
                break
            slots = (slots + 1) & ((1 << self.bits) - 1)
            hit = open_ & (self.keys[slots] == keys)
            out[hit] = self.ranks[slots[hit]]
            open_ &= ~hit & (self.keys[slots] != np.uint64(2**64 - 1))
        out[right == _GONE] = _NEVER
        return out

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words whose byte lengths are alike."""
        width = max(map(len, words))
        ids = np.full((len(words), width), _GONE, np.int32)
        for i, w in enumerate(words):
            ids[i, : len(w)] = self.bytes[np.frombuffer(w, np.uint8)]
        rows, out = np.arange(len(words)), [None] * len(words)
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:]) if width > 1 else np.empty((len(words), 0), np.int32)
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), _NEVER)
            done = best == _NEVER
            for i in np.nonzero(done)[0]:
                row = ids[i]
                out[rows[i]] = row[row != _GONE]
            live = ~done
            rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
            if not len(rows):
                break
            # compaction: everything behind the merged pair moves one place to the left
            n = np.arange(len(rows))
            column = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.where(column > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[n, at] = best
            pair = np.arange(ranks.shape[1] - 1)[None, :]
            ranks = np.where(pair > at[:, None], ranks[:, 1:], ranks[:, :-1])
            if ranks.shape[1]:  # only the two pairs that touch the merged token are new
                after = at < ranks.shape[1]
                ranks[n[after], at[after]] = self.pair_ranks(ids[n[after], at[after]], ids[n[after], at[after] + 1])
                before = at > 0
                ranks[n[before], at[before] - 1] = self.pair_ranks(ids[n[before], at[before] - 1], ids[n[before], at[before]])
        return out

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word: every round merges all disjoint pairs of the least rank, from the left."""
        ids = self.bytes[np.frombuffer(word, np.uint8)]
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != _NEVER:
            at = np.nonzero(ranks == least)[0]
            # of pairs that overlap every other one is merged, from the left of their run
            first = np.concatenate([[True], np.diff(at) > 1])
            start = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            at = at[(at - start) % 2 == 0]
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, ranks = ids[keep], np.append(ranks, _NEVER)[keep][:-1]
            at = at - np.arange(len(at))
            near = np.unique(np.concatenate([at[at < len(ranks)], at[at > 0] - 1]))
            ranks[near] = self.pair_ranks(ids[near], ids[near + 1])
        return ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text; null and empty texts give an empty array."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        fresh = {w for words in split for w in words if w not in self.cache}
        known = self.cache
        if fresh:
            if len(known) + len(fresh) > _CACHE_WORDS:
                known.clear()
                fresh = {w for words in split for w in words}
            as_bytes = sorted(((w.encode("utf-8", "surrogatepass"), w) for w in fresh), key=lambda x: len(x[0]))
            while as_bytes and len(as_bytes[-1][0]) >= LONG:
                b, w = as_bytes.pop()
                known[w] = self.merge_long(b)
            start = 0
            while start < len(as_bytes):
                short = len(as_bytes[start][0])
                limit = max(4, short + short // 4)  # rows of a bucket differ in length by a quarter at most
                end = start
                while end < len(as_bytes) and len(as_bytes[end][0]) <= limit and (end - start) * limit < 2_000_000:
                    end += 1
                end = max(end, start + 1)
                for (_, w), ids in zip(as_bytes[start:end], self.merge([b for b, _ in as_bytes[start:end]]), strict=True):
                    known[w] = ids
                start = end
        empty = np.empty(0, np.int32)
        return [np.concatenate([known[w] for w in words]) if words else empty for words in split]


def encode_documents(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of every document; null and empty texts give an empty list. Repeated rows repeat."""

    def encode(batches):
        vocabulary = Vocabulary.load(path)
        for pdf in batches:
            for start in range(0, len(pdf), 2000):
                some = pdf.iloc[start : start + 2000]
                yield pd.DataFrame({"doc_id": some.doc_id, "ids": vocabulary.encode(some.text.tolist())})

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return documents.select("doc_id", "text").mapInPandas(encode, schema)


def count_tokens(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens: the length of each document's ids, without moving the ids."""

    def count(batches):
        vocabulary = Vocabulary.load(path)
        for pdf in batches:
            for start in range(0, len(pdf), 2000):
                some = pdf.iloc[start : start + 2000]
                yield pd.DataFrame({"doc_id": some.doc_id, "tokens": np.array([len(x) for x in vocabulary.encode(some.text.tolist())], dtype=np.int32)})

    return documents.select("doc_id", "text").mapInPandas(count, "doc_id long, tokens int")
