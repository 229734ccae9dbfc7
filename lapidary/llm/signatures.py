"""Candidates for similar sets: minhash signatures and bands of them.

A signature has ``SIZE`` bytes, each of a minhash of its own; two sets of similarity s agree in one with probability s, and by
chance in one of 256 others. The first ``CHECKED`` bytes are for a check, the others for bands: a band is a choice of ``ROWS``
of them. Sets that agree in a whole band meet in a bucket and are candidates if ``LEAST`` of the checked bytes agree, too. Of
pairs with similarity 0.6 one in a hundred misses all bands, at 0.65 one in a thousand, none to speak of from 0.7 on. How many
candidates a set has isn't bounded by anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.llm.words import mix

CHECKED, LEAST, ROWS, BANDS = 16, 4, 5, 64
SIZE = CHECKED + 128
#: Pairs of a bucket that are checked at once.
AT_ONCE = 1_000_000

POSTED = "bucket bigint, mine boolean, hashes binary, ids binary, checked binary"


@lru_cache(16)
def _drawn(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(multipliers, masks, bytes of the bands) of a seed."""
    rng = np.random.RandomState(7919 * seed + 5)
    odd = (rng.randint(0, 1 << 31, SIZE).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
    masks = rng.randint(0, 1 << 32, SIZE, dtype=np.uint64).astype(np.uint32)
    # Every byte stands in as many bands as any other, but for one.
    rounds = -(-BANDS // (128 // ROWS))
    bands = np.concatenate([rng.permutation(128)[: 128 // ROWS * ROWS].reshape(-1, ROWS) for _ in range(rounds)])[:BANDS]
    return odd, masks, CHECKED + bands


def signatures(members: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A row of bytes for each set; set k has the members from ``ends[k]`` to ``ends[k + 1]``, at least one."""
    odd, masks, _ = _drawn(seed)
    members = members.view(np.uint32)
    out = np.empty((len(ends) - 1, SIZE), np.uint8)
    for at in range(0, len(out), 2048):
        e = ends[at : at + 2049]
        own, starts = members[e[0] : e[-1]], (e[:-1] - e[0]).astype(np.intp)
        hashed = np.empty_like(own)
        for k in range(SIZE):
            np.bitwise_xor(own, masks[k], out=hashed)
            np.multiply(hashed, odd[k], out=hashed)
            out[at : at + 2048, k] = (np.minimum.reduceat(hashed, starts) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def _signed(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(batch.schema.get_field_index("shingles"))
                rows = signatures(lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), seed)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in rows], pa.binary())], [*batch.schema.names, "signature"])

    return run


def signed(df: DataFrame, seed: int = 0) -> DataFrame:
    """``df`` with the column signature, without rows that have no shingle."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.where(F.size("shingles") > 0).mapInArrow(_signed(seed), f"{fields}, signature binary")


def band_hashes(rows: np.ndarray, band: int, seed: int = 0) -> np.ndarray:
    """32 bits for each signature, the same where those agree in the band."""
    whole = np.full(len(rows), band + 1, np.uint64)
    for k in _drawn(seed)[2][band]:
        whole = (whole << np.uint64(8)) | rows[:, k]
    return (mix(whole) >> np.uint64(32)).astype(np.uint32)


def posted(df: DataFrame, mine: bool, bands: range, splits: int, seed: int) -> DataFrame:
    """The postings of ``df`` (id, signature) for the buckets, ``splits`` of each band, packed by the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, SIZE)
            out = []
            for band in bands:
                h = band_hashes(rows, band, seed)
                split = h % np.uint32(splits)
                order = np.argsort(split, kind="stable")
                cuts = np.searchsorted(split[order], np.arange(splits + 1))
                for s in np.flatnonzero(np.diff(cuts)):
                    at = order[cuts[s] : cuts[s + 1]]
                    out.append((band * splits + int(s), mine, h[at].tobytes(), ids[at].tobytes(), rows[at, :CHECKED].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "mine", "hashes", "ids", "checked"])

    return df.select("id", "signature").mapInArrow(run, POSTED)


def _joined(parts: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, ids, checked = (b"".join(x) for x in zip(*parts))
    return np.frombuffer(hashes, np.uint32), np.frombuffer(ids, np.int64), np.frombuffer(checked, np.uint8).reshape(-1, CHECKED)


def meeting(queries: list, index: list, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The candidates (query, node) of a bucket; an id meets itself in every bucket and counts in the ``first`` one."""
    hq, iq, cq = _joined(queries)
    hn, nodes, cn = _joined(index)
    order = np.argsort(hn, kind="stable")
    hn = hn[order]
    low = np.searchsorted(hn, hq, "left")
    many = np.searchsorted(hn, hq, "right") - low
    some = np.flatnonzero(many)
    so_far = np.cumsum(many[some])
    at = 0
    while at < len(some):
        stop = max(at + 1, int(np.searchsorted(so_far, (so_far[at - 1] if at else 0) + AT_ONCE, "right")))
        q = some[at:stop]
        n = many[q]
        place = np.repeat(low[q] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        q, k = np.repeat(q, n), order[place]
        ok = (cq[q] == cn[k]).sum(axis=1) >= LEAST
        if not first:
            ok &= iq[q] != nodes[k]
        yield iq[q[ok]], nodes[k[ok]]
        at = stop


def _met(splits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for bucket, mine, *part in zip(*(batch.column(c).to_pylist() for c in ("bucket", "mine", "hashes", "ids", "checked"))):
                buckets.setdefault(bucket, ([], []))[mine].append(part)
        for bucket in sorted(buckets):
            index, queries = buckets.pop(bucket)
            if index and queries:
                for q, n in meeting(queries, index, bucket < splits):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(n)], ["query_id", "node_id"])

    return run


def met(postings: DataFrame, splits: int) -> DataFrame:
    """The candidates (query_id, node_id) of buckets that lie whole in a partition, with repeats."""
    return postings.select("bucket", "mine", "hashes", "ids", "checked").mapInArrow(_met(splits), "query_id bigint, node_id bigint")


def hinted(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """``df`` without most rows whose ``column`` isn't among ``ids`` (one column): a bitmap with eight places for each id is
    broadcast, a byte an id."""
    places = 8 * max(4096, ids.count())

    def place(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(places))

    at = place(F.col(ids.columns[0]))
    bits = ids.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    rows = df.withColumn("_at", F.bitmap_bit_position(place(F.col(column)))).withColumn("_bucket", F.bitmap_bucket_number(place(F.col(column))))
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as int)")
    return rows.join(F.broadcast(bits), "_bucket").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0).drop("_at", "_bucket", "_bits")
