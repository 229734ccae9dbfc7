"""Problem 1: evaluation passages inside training texts, by Wu-Manber multi-pattern search over words.

Every run of ``MIN_RUN`` consecutive words of an evaluation question or answer is a pattern. The symbols are words,
a block is two adjacent words. The shift table tells for the block at the end of the current window how many
positions can be skipped; a shift of 0 leads to a bucket chosen by the last four words of the window, whose
patterns are compared word by word.

The evaluation texts are kept once, as numbers of their words; a pattern is a place in them. Shift table and buckets are
tables of fixed size over hashes; where two blocks share a place the shorter shift holds, so nothing is missed.

Null and empty texts hold no patterns; items with fewer than ``MIN_RUN`` words have none. Repeated rows and repeated
passages give one case. Extra columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm.words import mix, words
from lapidary.session import durable

MIN_RUN = 12
BLOCK, SUFFIX = 2, 4
#: At most so many characters of evaluation text go to the workers at once (an item alone may be longer); more items are searched in further passes.
MAX_BROADCAST_CHARS = 16_000_000
#: Places of the shift table and of the buckets, and the factor of their hashes.
PLACES, FACTOR = 1 << 22, 0x9E3779B1
_MASK = PLACES - 1


def _hash(numbers: list) -> int:
    """The hash of some word numbers, as numbers or as arrays of them."""
    h = numbers[0]
    for x in numbers[1:]:
        h = (h * FACTOR + x) & 0xFFFFFFFF
    return (h ^ (h >> 15)) & _MASK


class WuManber:
    """Search tables for all runs of ``m`` words of the given item texts."""

    def __init__(self, items: Iterable[tuple[int, str | None]], m: int = MIN_RUN):
        self.m, self.longest, self.suffix = m, m - BLOCK + 1, min(SUFFIX, m)
        self.numbers: dict[str, int] = {}
        ids, lengths, owners = array("i"), [], []
        for item, text in items:
            w = words(text)
            if len(w) >= m:
                ids.extend([self.numbers.setdefault(x, len(self.numbers) + 1) for x in w])
                lengths.append(len(w))
                owners.append(item)
        self.ids = ids
        flat = np.frombuffer(ids, np.int32).astype(np.int64) if len(ids) else np.empty(0, np.int64)
        starts = np.cumsum([0, *lengths])
        within = np.arange(len(flat)) - np.repeat(starts[:-1], lengths)
        shift = np.full(PLACES, self.longest, np.uint8)
        at = np.flatnonzero(within >= 1)
        # The latest window that ends at or after a block decides how near a match can be.
        np.minimum.at(shift, _hash([flat[at - 1], flat[at]]), np.maximum(0, m - 1 - within[at]).astype(np.uint8))
        self.shift = shift.tobytes()
        # One place stands for all windows with the same words; it names the items of all of them.
        ends = np.flatnonzero(within >= m - 1)
        key = np.zeros(len(ends), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(m):
                key = mix(key * np.uint64(FACTOR) + flat[ends - m + 1 + j].astype(np.uint64))
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        item = np.repeat(np.arange(len(owners)), lengths)[ends] if len(ends) else np.empty(0, np.int64)
        pairs = np.unique(np.stack([group, item], 1), axis=0) if len(ends) else np.empty((0, 2), np.int64)
        self.of_group = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)).tolist() if len(ends) else [0]
        self.items = [owners[k] for k in pairs[:, 1]]
        self.end = array("i", ends[first].astype(np.int32).tobytes()) if len(ends) else array("i")
        # Buckets: the first pattern of each place, and the next one of each pattern.
        place = _hash([flat[ends[first] - self.suffix + 1 + j] for j in range(self.suffix)]) if len(ends) else np.empty(0, np.int64)
        head, following = np.full(PLACES, -1, np.int32), np.full(len(first), -1, np.int32)
        order = np.argsort(place, kind="stable")
        same = place[order][1:] == place[order][:-1] if len(order) else np.empty(0, bool)
        following[order[:-1][same]] = order[1:][same]
        starts_of = np.r_[True, ~same] if len(order) else np.empty(0, bool)
        head[place[order][starts_of]] = order[starts_of]
        self.head, self.following = array("i", head.tobytes()), array("i", following.tobytes())

    def find(self, text: str | None) -> set[int]:
        """Items of which a run of ``m`` words stands in ``text``."""
        get = self.numbers.get
        w = array("i", [get(x, 0) for x in words(text)])
        n, m, i, k = len(w), self.m, self.m - 1, self.suffix
        shift, head, longest = self.shift, self.head, self.longest
        found: set[int] = set()
        while i < n:
            a, b = w[i - 1], w[i]
            if not a or not b:
                i += longest  # a word that no item holds
                continue
            h = (a * FACTOR + b) & 0xFFFFFFFF
            s = shift[(h ^ (h >> 15)) & _MASK]
            if s:
                i += s
                continue
            p = head[_hash(w[i - k + 1 : i + 1])]
            if p >= 0:
                window = w[i - m + 1 : i + 1]
                while p >= 0:
                    e = self.end[p]
                    if self.ids[e - m + 1 : e + 1] == window:
                        found.update(self.items[self.of_group[p] : self.of_group[p + 1]])
                    p = self.following[p]
            i += 1
        return found


_TABLES: dict[int, WuManber] = {}


def _scanner(shared, number: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _TABLES.get(number)
        if tables is None:
            _TABLES.clear()
            tables = _TABLES[number] = WuManber(shared.value)
        for batch in batches:
            rows, items = [], []
            columns = [batch.column(i).to_pylist() for i in range(2, batch.num_columns)]
            for i, texts in enumerate(zip(*columns)):
                found: set[int] = set()
                for t in texts:
                    if t:
                        found |= tables.find(t)
                rows += [i] * len(found)
                items += found
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(items, pa.int64())], ["tab", "rec_key", "item_id"])

    return scan


def _blocks(evals: DataFrame, most: int) -> tuple[DataFrame, int]:
    """``evals`` with block, and the number of blocks: none has more than ``most`` characters, but for one that holds one item."""
    rows = evals.withColumn("_size", F.coalesce(F.length("question"), F.lit(0)) + F.coalesce(F.length("answer"), F.lit(0)))
    total, items = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.countDistinct("item_id")).first()
    blocks = int(total // most) + 1
    while True:
        cut = rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
        by = cut.groupBy("block").agg(F.sum("_size").alias("size"), F.countDistinct("item_id").alias("items"))
        if blocks >= 64 * (items + 1) or by.where((F.col("size") > most) & (F.col("items") > 1)).isEmpty():
            return cut.drop("_size"), blocks
        blocks *= 2


def leaked_items(records: DataFrame, evals: DataFrame, most: int | None = None) -> DataFrame:
    """(tab, rec_key, item_id) for every record of which a text holds a passage of an item.

    ``records`` has tab, rec_key and texts; ``evals`` has item_id, question, answer. It is searched in blocks of bounded
    size, one after the other: each goes to all workers, and is let go when what it finds is written.
    """
    spark = records.sparkSession
    evals = evals.select(F.col("item_id").cast("bigint").alias("item_id"), "question", "answer").dropna(subset=["item_id"]).distinct()
    rows, blocks = _blocks(evals, MAX_BROADCAST_CHARS if most is None else most)
    found = None
    for b in range(blocks):
        own = [(r.item_id, t) for r in rows.where(F.col("block") == b).collect() for t in (r.question, r.answer) if t]
        if not own and found is not None:
            continue
        shared = spark.sparkContext.broadcast(own)
        part = records.mapInArrow(_scanner(shared, shared._jbroadcast.id()), "tab string, rec_key string, item_id bigint")
        if blocks > 1:
            part = durable(part)
            shared.destroy()
        found = part if found is None else found.union(part)
    return found.distinct()


def leaks(documents: DataFrame, final_records: DataFrame, evals: DataFrame) -> DataFrame:
    """Cases (tab, rec_key, item_id) over documents.text and the question and answer of final_records."""
    d = documents.select(F.lit("documents").alias("tab"), F.col("doc_id").cast("string").alias("rec_key"), F.col("text").alias("a"), F.lit(None).cast("string").alias("b"))
    f = final_records.select(F.lit("final_records").alias("tab"), F.col("idx").cast("string").alias("rec_key"), F.col("question").alias("a"), F.col("answer").alias("b"))
    return leaked_items(d.union(f), evals)
