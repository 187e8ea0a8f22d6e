"""Byte-level BPE: two-tier encoding and decoding over rank files.

A text is split by the vocabulary's pattern. Each pre-token is first looked up whole through a minimal perfect hash of the
vocabulary; one that is not there is merged from its bytes, with a heap of the possible merges over linked bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .common import Recent, in_slices

_MASK = (1 << 64) - 1
#: Characters of the texts whose results leave a task together.
SLICE = 4_000_000


class MinimalPerfectHash:
    """Maps n distinct byte strings one to one onto 0..n-1: a bucket's displacement is the first that gives all its keys free places; keys that are alone in their bucket get the places left over."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.n_buckets = max(1, n // 3)
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for key in keys:
            h = xxhash.xxh64_intdigest(key)
            buckets[h % self.n_buckets].append(h)
        free = bytearray(b"\1" * n)
        self.shift = [0] * self.n_buckets
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        alone = []
        for b in order:
            if len(buckets[b]) < 2:
                alone += [b] * len(buckets[b])
                continue
            d = 1
            while True:
                places = {self._place(h, d) for h in buckets[b]}
                if len(places) == len(buckets[b]) and all(free[p] for p in places):
                    break
                d += 1
            self.shift[b] = d
            for p in places:
                free[p] = 0
        for b, p in zip(alone, (p for p in range(n) if free[p])):
            self.shift[b] = -p - 1

    def _place(self, h: int, d: int) -> int:
        x = (h ^ d * 0x9E3779B97F4A7C15) & _MASK
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & _MASK
        return (x ^ x >> 29) % self.n

    def __call__(self, key: bytes) -> int:
        """The key's place; that of some other key for a key that was not given."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.n_buckets]
        return -d - 1 if d < 0 else self._place(h, d)


class Codec:
    """Encoder and decoder of one vocabulary. Small enough to broadcast: it grows with the vocabulary alone."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.place = MinimalPerfectHash(list(ranks))
        self.at: list[tuple[bytes, int]] = [(b"", -1)] * len(ranks)
        for token, rank in ranks.items():
            self.at[self.place(token)] = (token, rank)
        self.token = dict(zip(ranks.values(), ranks))
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        #: (left id, right id) -> id of the merged token
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merged[left, right] = rank
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.memory = Recent(lambda piece: self.encode_piece(piece.encode()))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memory")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        token, rank = self.at[self.place(piece)]
        return (rank,) if token == piece else self.merge(piece)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merges the pair of the lowest rank, the leftmost first, until no pair is left."""
        ids = [self.byte_id[b] for b in piece]
        n, merged = len(ids), self.merged.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        #: rank of the pair that begins at each place, as last pushed; what differs in the heap is out of date
        pair = [merged(x, -1) for x in zip(ids, ids[1:])] + [-1]
        heap = [(rank, i) for i, rank in enumerate(pair) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if pair[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j], pair[j] = rank, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair[i] = merged((rank, ids[k]), -1)
                if pair[i] >= 0:
                    heapq.heappush(heap, (pair[i], i))
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                pair[h] = merged((ids[h], rank), -1)
                if pair[h] >= 0:
                    heapq.heappush(heap, (pair[h], h))
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memory.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with a base64 token and its rank on each line; only the driver reads it."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_codecs: dict[tuple[str, str], Codec] = {}


def codec_of(path: str, pattern: str) -> Codec:
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(path), pattern)
    return _codecs[key]


def encoder(spark: SparkSession, path: str, pattern: str):
    """A function from a text column to the column of its ids (array of int). A null text has the ids of the empty text: none."""
    shared = spark.sparkContext.broadcast(codec_of(path, pattern))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = shared.value
        for texts in batches:
            yield pd.Series([np.array(codec.encode(x or ""), np.int32) for x in texts], dtype=object)

    return encode


def decoder(spark: SparkSession, path: str, pattern: str):
    """A function from a column of ids to the bytes that they stand for; null ids give no bytes. An id outside the vocabulary is an error."""
    shared = spark.sparkContext.broadcast(codec_of(path, pattern))

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = shared.value
        for ids in batches:
            yield pd.Series([b"" if x is None else codec.decode(x.tolist()) for x in ids], dtype=object)

    return decode


def round_trip(spark: SparkSession, path: str, pattern: str, with_ids: bool = False):
    """A function from a text column to the struct of its n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 (of the bytes decoded from the ids), and of the ids themselves where they are asked for; else a text's ids live no longer than its own row takes. A null text counts as empty."""
    shared = spark.sparkContext.broadcast(codec_of(path, pattern))
    fields = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = shared.value
        decimal = {i: str(i) for i in codec.token}
        for texts in chain.from_iterable(in_slices(batch, SLICE) for batch in batches):
            rows = []
            for x in texts:
                ids = codec.encode(x or "")
                joined = " ".join(map(decimal.__getitem__, ids))
                row = len(ids), sha256(joined.encode()).hexdigest(), sha256(codec.decode(ids)).hexdigest()
                rows.append((*row, np.array(ids, np.int32)) if with_ids else row)
            yield pd.DataFrame(rows, columns=fields)

    return digests
