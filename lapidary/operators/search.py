"""Many strings looked for in many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.session import durable

#: Characters of strings that go to the workers at once; further strings are searched in further passes.
BLOCK_CHARS = 4_000_000


def _automaton(strings: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in strings:
        if t:
            a.add_word(t, t)
    if len(a):
        a.make_automaton()
    return a


_BUILT: dict[int, object] = {}


def _scan(shared, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _BUILT:
            _BUILT.clear()
            _BUILT[number] = _automaton(shared.value)
        automaton, empty = _BUILT[number], "" in shared.value
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                hits = {t for _, t in automaton.iter(text)} if len(automaton) else set()
                if empty:
                    hits.add("")
                rows += [i] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["key", "string"])

    return run


def mentions(texts: DataFrame, key: str, text: str, strings: DataFrame, string: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, string) of every text that holds a string of ``strings``, by an automaton over a block of strings at a time.

    Null texts and null strings match nothing, an empty string every text. Repeated rows give one row.
    """
    spark = texts.sparkSession
    distinct = durable(strings.where(F.col(string).isNotNull()).select(F.col(string).alias("string")).distinct())
    chars = distinct.agg(F.sum(F.length("string") + 1)).first()[0] or 0
    source = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    blocks = int(chars // block_chars) + 1
    parts = []
    for b in range(blocks):
        own = [r.string for r in distinct.where(F.pmod(F.xxhash64("string"), F.lit(blocks)) == b).collect()]
        shared = spark.sparkContext.broadcast(own)
        parts.append(source.mapInArrow(_scan(shared, shared._jbroadcast.id()), f"key {kind}, string string"))
    return reduce(DataFrame.union, parts).distinct()
