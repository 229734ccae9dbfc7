"""Shingle sets and their sketches, one pass of a Python worker over each text.

A text has the set of hashes of its runs of three words (see ``words``), ``T`` minhash coordinates, and a sketch of
128 one-bit minhashes: two texts of similarity s agree in (1 + s) / 2 of its bits on average.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.words import mix, shingle_hashes, shingles, word_hash, words

SHINGLE = 3
COORDINATES, BITS = 64, 128
_RANDOM = np.random.RandomState(20240229)
_A = (_RANDOM.randint(0, 1 << 62, BITS, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RANDOM.randint(0, 1 << 62, BITS, dtype=np.int64).astype(np.uint64)
_POWERS = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)

SCHEMA = "h1 bigint, h2 bigint, shingles array<int>, coordinates array<int>, s1 bigint, s2 bigint"


def sketch(text: str | None):
    """(h1, h2, shingles, coordinates, s1, s2), or None for a text without a shingle. h1 and h2 tell the whole set."""
    h = shingles(text, SHINGLE)
    if not len(h):
        return None
    with np.errstate(over="ignore"):
        small = np.unique((h >> np.uint64(32)).astype(np.uint32))
        whole = mix(small.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
        least = np.empty(BITS, np.uint64)
        for at in range(0, len(h), 4096):
            m = (h[at : at + 4096, None] * _A[None, :] + _B[None, :]).min(axis=0)
            least = np.minimum(least, m) if at else m
        bits = mix(least) >> np.uint64(63)
        both = (bits.reshape(2, 64) * _POWERS[None, :]).sum(axis=1, dtype=np.uint64).view(np.int64)
        coordinates = (mix(least[:COORDINATES]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        h1, h2 = np.array([whole.sum(dtype=np.uint64), (whole * whole).sum(dtype=np.uint64)], np.uint64).view(np.int64)
    return int(h1), int(h2), small.view(np.int32), coordinates, int(both[0]), int(both[1])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32), pa.int32()))


def _sketches(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            for i, text in enumerate(batch.column(n_keys).to_pylist()):
                if (s := sketch(text)) is not None:
                    kept.append(i)
                    rows.append(s)
            h1, h2, sh, co, s1, s2 = zip(*rows) if rows else ((),) * 6
            keys = [batch.column(k).take(pa.array(kept, pa.int64())) for k in range(n_keys)]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), _lists(list(sh)), _lists(list(co)), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())],
                [*batch.schema.names[:n_keys], "h1", "h2", "shingles", "coordinates", "s1", "s2"],
            )

    return run


def sketched(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys`` and the sketch columns of every row whose text has a shingle."""
    source = df.select(*keys, text.alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(_sketches(len(keys)), f"{fields}, {SCHEMA}")


SETS = "h1 bigint, h2 bigint, shingles array<int>"


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts that have a shingle, h1, h2, ends, members): the sets of ``sketch`` of many texts at once."""
    numbers: list[int] = []
    lengths = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        w = words(text)
        lengths[i] = len(w)
        numbers += map(word_hash, w)
    starts = np.cumsum(np.r_[0, lengths])
    h = shingle_hashes(np.array(numbers, np.uint64), SHINGLE)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.maximum(lengths - SHINGLE + 1, 0))
    inside = np.concatenate([np.arange(a, max(a, b - SHINGLE + 1)) for a, b in zip(starts, starts[1:])]) if len(texts) else np.empty(0, np.int64)
    members = np.unique((owner << np.uint64(32)) | (h[inside.astype(np.int64)] >> np.uint64(32)))
    owner, members = (members >> np.uint64(32)).astype(np.int64), members & np.uint64(0xFFFFFFFF)
    kept, first = np.unique(owner, return_index=True)
    with np.errstate(over="ignore"):
        whole = mix(members * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7))
        h1, h2 = (np.add.reduceat(x, first) if len(first) else np.empty(0, np.uint64) for x in (whole, whole * whole))
    return kept, h1.view(np.int64), h2.view(np.int64), np.r_[first, len(members)].astype(np.int32), members.astype(np.uint32).view(np.int32)


def shingle_set(text: str | None):
    """(h1, h2, shingles) as in ``sketch``, without the minhashes."""
    kept, h1, h2, _, members = shingle_sets([text])
    return (int(h1[0]), int(h2[0]), members) if len(kept) else None


def _sets(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, h1, h2, ends, members = shingle_sets(batch.column(n_keys).to_pylist())
            keys = [batch.column(k).take(pa.array(kept, pa.int64())) for k in range(n_keys)]
            sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(members, pa.int32()))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), sets], [*batch.schema.names[:n_keys], "h1", "h2", "shingles"])

    return run


def with_sets(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys`` and the set columns of every row whose text has a shingle."""
    source = df.select(*keys, text.alias("_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(_sets(len(keys)), f"{fields}{SETS}")


def differing_bits(a: str, b: str) -> Column:
    """Bits in which the sketches of the two aliases differ."""
    return F.expr(f"bit_count({a}.s1 ^ {b}.s1) + bit_count({a}.s2 ^ {b}.s2)")


def most_differing(least: float) -> int:
    """So many bits differ at most, but for about one in a thousand, at similarity ``least``."""
    p = (1 - least) / 2
    return int(BITS * p + 3.3 * (BITS * p * (1 - p)) ** 0.5)


def similarity(a: str, b: str) -> Column:
    """Exact similarity of the shingle sets of two array columns."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)
