"""Problem 5: the N best rows of every group, by a global range-partitioned sort.

Rows are range-partitioned and sorted by group, rank columns and identifier, so a group of any size spreads over as
many partitions as it needs. Each partition passes on its first N rows of every group and the group's row count; the
counts are prefix-summed over the partitions into exact positions, and positions up to N are kept.

Rows with a null group or a null or NaN score take no part. Repeated deliveries are adjacent after the sort and count
once. Ties are settled by the later time (a null time comes last), then by the smaller identifier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 3


def _changes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Where a row differs from the one before; True at the start."""
    n = batch.num_rows
    out = np.zeros(n, bool)
    out[:1] = True
    for c in names:
        col = batch.column(c)
        differs = pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, n - 1)), True)
        out[1:] |= differs.to_numpy(zero_copy_only=False)
    return out


def _heads(group: list[str], ident: str, top: int):
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_group, last_id, count, part = None, None, 0, 0

        def total() -> list:
            return [part, *(last_group or [None] * len(group)), None, 0, count]

        names = ["part", *group, ident, "place", "n"]
        kinds = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if kinds is None:
                kinds = [pa.int32(), *[batch.schema.field(g).type for g in group], batch.schema.field(ident).type, pa.int64(), pa.int64()]
            new_group = _changes(batch, group)
            new_row = new_group | _changes(batch, [ident])
            first = [batch.column(g)[0].as_py() for g in group]
            if last_group == first:
                new_group[0] = False
                new_row[0] = batch.column(ident)[0].as_py() != last_id
            part = batch.column("part")[0].as_py()
            rows: list[list] = []
            starts = np.flatnonzero(new_group)
            # Position within the group, carried over from the batch before.
            running = np.cumsum(new_row)
            base = np.zeros(batch.num_rows, np.int64)
            edges = [0, *[s for s in starts if s], batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                carried = count if a == 0 and not new_group[0] else 0
                if new_group[a] and last_group is not None:
                    rows.append(total())
                base[a:b] = carried - (running[a - 1] if a else 0)
                last_group = [batch.column(g)[int(a)].as_py() for g in group]
                count = int(running[b - 1] + base[b - 1])
            place = running + base
            keep = np.flatnonzero(new_row & (place <= top))
            ids = batch.column(ident).take(pa.array(keep)).to_pylist()
            keys = [batch.column(g).take(pa.array(keep)).to_pylist() for g in group]
            rows += [[part, *k, i, int(p), 0] for *k, i, p in zip(*keys, ids, place[keep])]
            last_id = batch.column(ident)[batch.num_rows - 1].as_py()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        if last_group is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(total(), kinds)], names)

    return heads


def top_of_groups(df: DataFrame, group: list[str], order: list, ident: str, top: int = TOP) -> DataFrame:
    """(group..., ident, position) of the first ``top`` rows of every group by the sort columns ``order``, then ``ident``."""
    sort = [*[F.col(g).asc() for g in group], *order, F.col(ident).asc()]
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort).select(F.spark_partition_id().alias("part"), *group, ident)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields if f.name != "part")
    heads = ranged.mapInArrow(_heads(group, ident, top), f"part int, {fields}, place bigint, n bigint")
    before = Window.partitionBy(*group).orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    placed = heads.withColumn("position", F.col("place") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    return placed.where((F.col("place") > 0) & (F.col("position") <= top)).select(*group, ident, F.col("position").cast("int").alias("position"))


def best_puzzles(puzzles: DataFrame, top: int = TOP) -> DataFrame:
    """(rule_id, created_day, id, position) of the best reviewed puzzles of each rule and day."""
    rows = puzzles.select("rule_id", F.date_format("created_at", "yyyy-MM-dd").alias("created_day"), "reviewer_score", "created_at", "id")
    rows = rows.where("rule_id is not null and created_day is not null and reviewer_score is not null and not isnan(reviewer_score)")
    return top_of_groups(rows, ["rule_id", "created_day"], [F.desc("reviewer_score"), F.desc("created_at")], "id", top)
