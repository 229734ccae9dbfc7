"""Problem 8: encoding of texts with a byte-level BPE vocabulary, in two tiers.

A minimal perfect hash over the vocabulary resolves pre-tokens that are tokens as a whole. Any other pre-token is
merged with a heap of adjacent pairs over a linked list of its bytes, always the pair of the lowest rank first. Each
worker keeps what it resolved in a table of bounded size.

A null or an empty text has the empty list. No special tokens are added; their strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KEPT = 400_000
_LONGEST_KEPT = 256


def read_ranks(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    with open(f"{folder}/{name}", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """A minimal perfect hash of byte strings: hash, displace, compare.

    Keys fall into buckets of about four. Bucket by bucket, the largest first, a displacement is sought that sends all
    keys of the bucket to free slots; a bucket of one key names its slot directly. There are as many slots as keys.
    """

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        n = self.n = max(1, len(keys))
        m = self.m = max(1, n // 4)
        buckets: list[list[tuple[int, int, int]]] = [[] for _ in range(m)]
        for i, key in enumerate(keys):
            h = xxhash.xxh128_intdigest(key)
            buckets[(h & 0xFFFFFFFF) % m].append(((h >> 32) & 0xFFFFFFFF, (h >> 64) & 0xFFFFFFFF, i))
        move = [0] * m
        slot: list[int] = [-1] * n
        for b in sorted(range(m), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) <= 1:
                break
            d = 1
            while True:
                at = [(x + d * y + d * d * 7) % n for x, y, _ in own]
                if len(set(at)) == len(at) and all(slot[a] < 0 for a in at):
                    break
                d += 1
            move[b] = d
            for a, (_, _, i) in zip(at, own):
                slot[a] = i
        free = iter([a for a in range(n) if slot[a] < 0])
        for b in range(m):
            if len(buckets[b]) == 1:
                a = next(free)
                move[b] = -a - 1
                slot[a] = buckets[b][0][2]
        self.move = np.array(move, np.int64).tolist()
        self.keys = [keys[i] if i >= 0 else b"" for i in slot]
        self.ids = [ranks[keys[i]] if i >= 0 else -1 for i in slot]

    def get(self, key: bytes) -> int:
        """The id of ``key``, or -1."""
        h = xxhash.xxh128_intdigest(key)
        d = self.move[(h & 0xFFFFFFFF) % self.m]
        a = -d - 1 if d < 0 else (((h >> 32) & 0xFFFFFFFF) + d * ((h >> 64) & 0xFFFFFFFF) + d * d * 7) % self.n
        return self.ids[a] if self.keys[a] == key else -1


#: The pattern for ASCII texts, where the classes are spelt out; the control characters that one engine takes for blanks go the other way.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+").findall
_CONTROL = re.compile("[\x1c-\x1f]").search


class Encoder:
    def __init__(self, table: PerfectHash, pattern: str = PATTERN):
        self.table = table
        self.pattern = regex.compile(pattern).findall
        self.ascii = _ASCII if pattern == PATTERN else self.pattern
        self.kept: dict[str, tuple[int, ...]] = {}
        self.single = [self.table.get(bytes([i])) for i in range(256)]

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that isn't in the vocabulary."""
        get = self.table.get
        n = len(raw)
        ids = [self.single[b] for b in raw]
        end = list(range(1, n + 1))  # the end of the piece that starts here
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := get(raw[i : i + 2])) >= 0:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            # Stale: the piece at i is gone, or it or its neighbour has changed.
            if ids[i] < 0 or after[i] >= n or end[after[i]] != stop or end[i] == stop:
                continue
            j = after[i]
            ids[i], ids[j] = rank, -1
            end[i] = stop
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(raw[i : end[k]])) >= 0:
                    heapq.heappush(heap, (r, i, end[k]))
            p = before[i]
            if p >= 0 and (r := get(raw[p:stop])) >= 0:
                heapq.heappush(heap, (r, p, stop))
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces = (self.ascii if text.isascii() and not _CONTROL(text) else self.pattern)(text)
        kept = self.kept
        try:
            return [*chain.from_iterable([kept[p] for p in pieces])]
        except KeyError:
            return [*chain.from_iterable([kept.get(p) or self.resolve(p) for p in pieces])]

    def resolve(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token, kept unless it is very long."""
        raw = piece.encode("utf-8", "replace")
        whole = self.table.get(raw)
        ids = (whole,) if whole >= 0 else self.merge(raw)
        if len(piece) <= _LONGEST_KEPT:
            if len(self.kept) >= _KEPT:
                self.kept.clear()
            self.kept[piece] = ids
        return ids


_ENCODERS: dict[int, Encoder] = {}


_TABLES: dict[tuple[str, str], PerfectHash] = {}
_SENT: dict[tuple[str, str, str], object] = {}


class Shared:
    """The table of the vocabulary, made once on the driver (its size is that of the vocabulary file) and sent to all workers once a session."""

    def __init__(self, spark, folder: str = TOKENIZERS, name: str = VOCABULARY):
        key = (spark.sparkContext.applicationId, folder, name)
        if key not in _SENT:
            if key[1:] not in _TABLES:
                _TABLES[key[1:]] = PerfectHash(read_ranks(folder, name))
            _SENT.clear()
            _SENT[key] = spark.sparkContext.broadcast(_TABLES[key[1:]])
        self.broadcast = _SENT[key]
        self.id = self.broadcast._jbroadcast.id()

    def encoder(self) -> Encoder:
        if self.id not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[self.id] = Encoder(self.broadcast.value)
        return _ENCODERS[self.id]


def _encode(shared: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.encoder().encode
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat: list[int] = []
                ends = [0]
                for text in part.column(1).to_pylist():
                    flat += encode(text)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return run


def encoded(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document."""
    shared = Shared(documents.sparkSession, folder, name)
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_encode(shared), "doc_id bigint, ids array<int>")


def _count(shared: Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.encoder().encode
        for batch in batches:
            n = pa.array([len(encode(t)) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "source", "n_tokens"])

    return run


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of every document."""
    shared = Shared(documents.sparkSession, folder, name)
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    return source.mapInArrow(_count(shared), "doc_id bigint, source string, n_tokens bigint")
