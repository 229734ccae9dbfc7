"""Problem 9: filling windows of fixed capacity with texts, mixture-controlled.

Every source has a queue of its texts, and windows are filled by deficit round-robin: with each window a source earns
credit in proportion to its share of all tokens, and pays for what it gives. The source with the most credit goes first
with the largest of its texts that fits; when a window is nearly full, whatever text fits best closes the gap. Windows cut
from long texts earn and charge as all others do.

The texts are dealt over blocks by a hash of the identifier, so a source of any size spreads evenly and no block
grows with the data; blocks pack in parallel. A block delivers all of its texts, so the deficit with which a source leaves
it is known beforehand: its share of the block's tokens less its own tokens there. The sums of these over all earlier
blocks are the credit with which a block begins, so deficits are carried from block to block and over partitions as if
the blocks were packed in a row. Windows that a block can't fill well are given up to a second round, which packs the
remainders of many blocks together, with the deficits that the blocks have without these.

Texts longer than a window are split into whole windows and a remainder. Texts without tokens take no room; they go to
the last window that their block closed. Null sources count as a source of their own. Repeated ids are packed once
each time they occur.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapidary.llm.bpe import TOKENIZERS, VOCABULARY, token_counts
from lapidary.operators.joins import split_join
from lapidary.session import durable

CAPACITY = 2048
#: Texts of a block, blocks whose remainders one task of the second round gets, and the fill below which a window is given up.
BLOCK, TOGETHER, FILL = 4000, 64, 0.995
#: The last such part of a window goes to the texts that fit best.
CLOSE = 8


class Queue:
    """Texts of one source by size; the largest that fits is found by bisection."""

    def __init__(self):
        self.sizes: list[int] = []
        self.by_size: dict[int, list[tuple]] = {}

    def push(self, size: int, item: tuple) -> None:
        own = self.by_size.get(size)
        if own is None:
            self.by_size[size] = [item]
            bisect.insort(self.sizes, size)
        else:
            own.append(item)

    def largest(self, room: int) -> int:
        """Size of the largest text that fits, or 0."""
        k = bisect.bisect_right(self.sizes, room)
        return self.sizes[k - 1] if k else 0

    def pop(self, size: int) -> tuple:
        own = self.by_size[size]
        item = own.pop()
        if not own:
            del self.by_size[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]
        return item


def fill(items: list[tuple], shares: dict, deficits: dict, capacity: int = CAPACITY, full: list[tuple] = ()) -> tuple[list[list[tuple]], dict]:
    """Windows of (source, id, piece, start, size), and the deficits that remain. ``items`` are such tuples, all of at most
    the capacity; ``full`` are whole windows of long texts, which come first."""
    queues: dict = {}
    everything = Queue()
    left: dict = {}
    gone: set[int] = set()
    for k, item in enumerate(items):
        queues.setdefault(item[0], Queue()).push(item[4], (k, item))
        everything.push(item[4], (k, item))
        left[item[0]] = left.get(item[0], 0) + 1
    credit = {s: deficits.get(s, 0.0) for s in {*queues, *(x[0] for x in full)}}
    windows: list[list[tuple]] = []

    def take(queue: Queue, room: int) -> tuple | None:
        # Texts that the other kind of queue has already given are skipped.
        while size := queue.largest(room):
            k, item = queue.pop(size)
            if k not in gone:
                gone.add(k)
                left[item[0]] -= 1
                credit[item[0]] -= item[4]
                return item
        return None

    def earn(tokens: int) -> None:
        for s in credit:
            credit[s] += tokens * shares.get(s, 0.0)

    for item in full:
        earn(item[4])
        credit[item[0]] -= item[4]
        windows.append([item])
    remaining = len(items)
    while remaining:
        earn(capacity)
        window, room = [], capacity
        blocked: set = set()
        while room > capacity // CLOSE:
            first = max((s for s in queues if left[s] and s not in blocked), key=lambda s: (credit[s], str(s)), default=blocked)
            if first is blocked:
                break
            if (item := take(queues[first], room)) is None:
                blocked.add(first)
                continue
            window.append(item)
            room -= item[4]
        while room and (item := take(everything, room)):
            window.append(item)
            room -= item[4]
        remaining -= len(window)
        windows.append(window)
        if room:
            earn(-room)  # what stays empty earns nothing
    return windows, credit


def _pieces(pdf: pd.DataFrame, capacity: int) -> tuple[list[list[tuple]], list[tuple], list[tuple]]:
    """Whole windows of long texts, the items to pack, and the texts without tokens."""
    full, items, empty = [], [], []
    for doc, source, n in zip(pdf["doc_id"], pdf["source"], pdf["n_tokens"]):
        source, n = source if isinstance(source, str) else None, int(n)
        if not n:
            empty.append((source, doc, 0, 0, 0))
            continue
        piece = start = 0
        while n - start >= capacity:
            full.append([(source, doc, piece, start, capacity)])
            piece, start = piece + 1, start + capacity
        if n > start:
            items.append((source, doc, piece, start, n - start))
    return full, items, empty


WINDOW_SCHEMA = "block bigint, window bigint, doc_id bigint, source string, piece int, start_token bigint, n_tokens bigint, kind string, share double, deficit double"
_COLUMNS = [x.split()[0] for x in WINDOW_SCHEMA.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"source": object, "kind": object})


def _named(source) -> str | None:
    return source if isinstance(source, str) else None


def _first_round(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        once = pdf.drop_duplicates("source")
        shares = {_named(s): x for s, x in zip(once["source"], once["share"])}
        carried = {_named(s): x for s, x in zip(once["source"], once["carry"])}
        full, items, empty = _pieces(pdf.sort_values(["n_tokens", "doc_id"]), capacity)
        windows, _ = fill(items, shares, carried, capacity, [x for w in full for x in w])
        good = [w for w in windows if sum(x[4] for x in w) >= FILL * capacity]
        rest = [x for w in windows if sum(y[4] for y in w) < FILL * capacity for x in w]
        rows = [(block, i, x[1], x[0], x[2], x[3], x[4], "window", None, None) for i, w in enumerate(good) for x in w]
        # Without a closed window the texts without tokens wait for the second round.
        rows += [(block, len(good) - 1, x[1], x[0], 0, 0, 0, "window" if good else "rest", shares[x[0]], None) for x in empty]
        rows += [(block, 0, x[1], x[0], x[2], x[3], x[4], "rest", shares[x[0]], None) for x in rest]
        given: dict = {}
        for w in good:
            for x in w:
                given[x[0]] = given.get(x[0], 0) + x[4]
        total = sum(given.values())
        rows += [(block, 0, -1, s, 0, 0, 0, "deficit", shares[s], shares[s] * total - given.get(s, 0)) for s in {x[0] for x in rest}]
        return _frame(rows)

    return run


def _second_round(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        shares = {_named(s): x for s, x in zip(pdf["source"], pdf["share"])}
        carried = pdf[pdf["kind"] == "deficit"]
        deficits: dict = {}
        for s, d in zip(carried["source"], carried["deficit"]):
            deficits[_named(s)] = deficits.get(_named(s), 0.0) + d
        rest = pdf[pdf["kind"] == "rest"].sort_values(["n_tokens", "doc_id", "piece"])
        items = [(_named(s), d, int(p), int(a), int(n)) for s, d, p, a, n in zip(rest["source"], rest["doc_id"], rest["piece"], rest["start_token"], rest["n_tokens"])]
        windows, _ = fill([x for x in items if x[4]], shares, deficits, capacity)
        empty = [x for x in items if not x[4]]
        if empty:
            windows = windows or [[]]
            windows[-1] = windows[-1] + empty
        return _frame([(-1 - group, i, x[1], x[0], x[2], x[3], x[4], "window", None, None) for i, w in enumerate(windows) for x in w])

    return run


def with_carry(sizes: DataFrame, blocks: int) -> DataFrame:
    """``sizes`` (doc_id, source, n_tokens) with block, the source's share of all tokens, and the credit it carries into the block."""
    dealt = sizes.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).withColumns({"_null": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))})
    # One row for each source of a block; all that follows is made of these.
    held = durable(dealt.groupBy("block", "_null", "_source").agg(F.sum("n_tokens").alias("own")))
    total = held.agg(F.sum("own")).first()[0] or 1
    shares = held.groupBy("_null", "_source").agg((F.sum("own") / F.lit(float(total))).alias("share"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = held.groupBy("block").agg(F.sum("own").alias("all")).withColumn("all_before", F.coalesce(F.sum("all").over(earlier), F.lit(0)))
    own = F.coalesce(F.sum("own").over(Window.partitionBy("_null", "_source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = held.withColumn("own_before", own).join(before, "block").join(shares, ["_null", "_source"])
    known = known.select("block", "_null", "_source", "share", (F.col("share") * F.col("all_before") - F.col("own_before")).alias("carry"))
    return split_join(dealt, known, ["block", "_null", "_source"], "inner").drop("_null", "_source")


def packed(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(window_id, doc_id, piece, start_token, n_tokens): every text, or piece of a long text, in its window."""
    sizes = durable(token_counts(documents, folder, name))
    blocks = max(1, -(-sizes.count() // BLOCK))
    # Neither the order nor the placement of rows depends on the run. The number of tasks is given, as a block is work whatever its bytes.
    dealt = with_carry(sizes, blocks).repartition(min(2 * blocks, 20_000), "block")
    first = durable(dealt.groupBy("block").applyInPandas(_first_round(capacity), WINDOW_SCHEMA))
    done = first.where("kind = 'window'")
    rest = first.where("kind <> 'window'").withColumn("block", F.floor(F.col("block") / TOGETHER))
    second = rest.groupBy("block").applyInPandas(_second_round(capacity), WINDOW_SCHEMA)
    named = F.concat_ws("-", F.when(F.col("block") < 0, "r").otherwise("b"), F.abs("block").cast("string"), F.col("window").cast("string"))
    return done.union(second).select(named.alias("window_id"), "doc_id", "piece", "start_token", "n_tokens")
