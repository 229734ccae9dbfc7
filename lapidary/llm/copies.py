"""Problem 2: records that differ only in formatting, by commutative multiset hashing.

Every field name and value pair is normalised (letters and digits only, lower case), hashed, and the hashes of a
record are summed, so the order of fields doesn't matter. Records are grouped by that fingerprint; each is then
compared field by field, by lookup, with the kept record of its group. Records that only share the fingerprint (a
collision) are grouped anew by the fingerprint under another seed, and compared again, until none is left.

Null values take no part (a null question is no record); texts without any letter or digit are equal to each other.
Repeated deliveries of a key count as one record. Lines that aren't one JSON value take no part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.operators.joins import split_join
from lapidary.session import durable

_NOT_KEPT = re.compile(r"[\W_]+")
_HALF = 0xFFFFFFFF


def normal(col: Column) -> Column:
    """Letters and digits of a text, in lower case."""
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", "")


def _flatten(value, path: str, out: dict[str, str]) -> None:
    if isinstance(value, dict):
        out[path + "{"] = ""
        for k, v in value.items():
            _flatten(v, f"{path}/{json.dumps(k, ensure_ascii=False)}", out)
    elif isinstance(value, list) and _holds_object(value):
        for i, v in enumerate(value):
            _flatten(v, f"{path}[{i}]", out)
    else:
        out[path] = _NOT_KEPT.sub("", _text(value).lower())


def _holds_object(value) -> bool:
    """Whether an object stands in a list, however deep."""
    return isinstance(value, dict) or isinstance(value, list) and any(map(_holds_object, value))


def _text(value) -> str:
    if isinstance(value, list):
        return "".join(map(_text, value))
    return value if isinstance(value, str) else json.dumps(value)


def line_fields(line: str | None) -> dict[str, str] | None:
    """Normalised values of a JSON line by the path of field names; None if it doesn't parse. Numbers keep their digits as written."""
    try:
        value = json.loads(line, parse_int=str, parse_float=str, parse_constant=str)
    except (ValueError, TypeError, RecursionError):
        return None
    out: dict[str, str] = {}
    _flatten(value, "", out)
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.map_(pa.string(), pa.string())
    for batch in batches:
        keys, fields = [], []
        for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (f := line_fields(line)) is not None:
                keys.append(key)
                fields.append(list(f.items()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(fields, kind)], ["rec_key", "fields"])


def parsed_lines(df: DataFrame, key: str, line: str) -> DataFrame:
    """(rec_key, fields) of every line that parses."""
    return df.select(F.col(key).cast("string").alias("rec_key"), F.col(line).alias("line")).mapInArrow(_parse, "rec_key string, fields map<string,string>")


def text_fields(df: DataFrame, key: str, *names: str) -> DataFrame:
    """(rec_key, fields) of every row of which no named text is null."""
    pairs = [x for n in names for x in (F.lit(n), normal(F.col(n)))]
    return df.dropna(subset=list(names)).select(F.col(key).cast("string").alias("rec_key"), F.create_map(*pairs).alias("fields"))


def fingerprint(fields: Column, seed: int = 0) -> Column:
    """Sum of the pair hashes of a map, in two halves of 32 bits each so that no sum of a long overflows."""
    hashes = F.transform(F.map_entries(fields), lambda e: F.xxhash64(F.lit(seed), e["key"], e["value"]))
    low = F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a + h.bitwiseAND(F.lit(_HALF)))
    high = F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a + F.shiftrightunsigned(h, 32))
    return F.struct(low.alias("low"), high.alias("high"))


def same_fields(a: Column, b: Column) -> Column:
    """Equality of two maps, by lookup instead of sorting."""
    return (F.size(a) == F.size(b)) & F.forall(F.map_keys(a), lambda k: F.element_at(a, k).eqNullSafe(F.try_element_at(b, k)))


def classes(records: DataFrame, *within: str) -> DataFrame:
    """One row per record of a class of two or more copies: ``within``, kept_key, copy_key (kept_key < copy_key).

    ``records`` has rec_key, fields and the columns ``within``. The smallest key of a class is kept. Groups are
    pre-aggregated to one row per fingerprint before they are shuffled, and the one kept row of each group is joined
    back, so no group is held in one place; a hot fingerprint's rows are split by the adaptive skew join.
    """
    out, seed = None, 0
    rows = records.select(*within, "rec_key", "fields", F.array(F.lit(0).cast("bigint")).alias("path"))
    while True:
        # The path holds the fingerprints that a record's group already shared.
        fp = fingerprint(F.col("fields"), seed)
        rows = rows.withColumn("path", F.concat("path", F.array(fp["low"], fp["high"])))
        by = [*within, "path"]
        kept = rows.groupBy(*by).agg(F.min("rec_key").alias("kept_key"), F.max("rec_key").alias("last"), F.min_by("fields", "rec_key").alias("kept_fields"))
        kept = kept.where("kept_key < last").drop("last")
        pairs = split_join(rows, kept, by, "inner").where(F.col("rec_key") > F.col("kept_key"))
        same = same_fields(F.col("fields"), F.col("kept_fields"))
        # Written once, the fields only of records that aren't copies after all.
        pairs = durable(pairs.select(*by, "kept_key", "rec_key", same.alias("same"), F.when(~same, F.col("fields")).alias("fields")))
        good = pairs.where("same").select(*within, "kept_key", F.col("rec_key").alias("copy_key"))
        out = good if out is None else out.union(good)
        rows, seed = pairs.where("not same").select(*within, "rec_key", "fields", "path"), seed + 1
        if rows.isEmpty():
            return out.distinct()


def records_of(puzzles: DataFrame, final_records: DataFrame, raw_records: DataFrame | None = None) -> DataFrame:
    """(tab, rec_key, fields) of the tables."""
    parts = [("puzzles", text_fields(puzzles, "id", "question")), ("final_records", text_fields(final_records, "idx", "question"))]
    if raw_records is not None:
        parts.append(("raw_records", parsed_lines(raw_records, "raw_id", "line")))
    records = None
    for tab, part in parts:
        named = part.select(F.lit(tab).alias("tab"), "rec_key", "fields")
        records = named if records is None else records.union(named)
    return records


def copies(puzzles: DataFrame, final_records: DataFrame, raw_records: DataFrame) -> DataFrame:
    """Cases (tab, kept_key, copy_key) of the three tables."""
    return classes(records_of(puzzles, final_records, raw_records), "tab")


def collapsed(records: DataFrame, *within: str) -> DataFrame:
    """One row per class of copies: ``within``, kept_key and n_copies (records of the class, repeated deliveries counted once)."""
    copies_ = durable(classes(records, *within))
    counted = copies_.groupBy(*within, "kept_key").agg((F.count("*") + 1).alias("n"))
    kept = records.select(*within, F.col("rec_key").alias("kept_key")).distinct()
    kept = kept.join(copies_.select(*within, F.col("copy_key").alias("kept_key")), [*within, "kept_key"], "left_anti")
    return kept.join(counted, [*within, "kept_key"], "left").select(*within, "kept_key", F.coalesce("n", F.lit(1)).cast("bigint").alias("n_copies"))
