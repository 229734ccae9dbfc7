import os
import random

import pytest
from pyspark.sql import functions as F

from lapidary.llm import bpe, packing

needs = pytest.mark.skipif(not os.path.exists(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}"), reason="no vocabulary")


def test_fill_follows_the_mixture():
    rng = random.Random(3)
    items = [(s, f"{s}{i}", 0, 0, rng.randrange(5, 200)) for s, n in (("a", 600), ("b", 300), ("c", 100)) for i in range(n)]
    total = sum(x[4] for x in items)
    shares = {s: sum(x[4] for x in items if x[0] == s) / total for s in "abc"}
    windows, _ = packing.fill(items, shares, {}, 1000)
    assert sorted(x for w in windows for x in w) == sorted(items)
    sizes = [sum(x[4] for x in w) for w in windows]
    assert max(sizes) <= 1000 and sum(sizes) / (1000 * len(sizes)) > 0.98
    # In every window: what a source has delivered so far is its share of all so far, within one window's room.
    off = drift(windows, shares)
    assert max(off) <= 1000


def drift(windows, shares, begun=None):
    """After each window the largest difference between what a source has delivered and its share, over the sources that still have texts."""
    left, given, total, out = {}, dict(begun or {}), sum((begun or {}).values()), []
    for w in windows:
        for x in w:
            left[x[0]] = left.get(x[0], 0) + 1
    for w in windows:
        for x in w:
            given[x[0]] = given.get(x[0], 0) + x[4]
            total += x[4]
            left[x[0]] -= 1
        out.append(max((abs(given.get(s, 0) - shares[s] * total) for s in shares if left.get(s)), default=0))
    return out


def test_long_texts_are_charged():
    rng = random.Random(5)
    full = [("long", f"l{i}", 0, 0, 1000) for i in range(50)]
    items = [(s, f"{s}{i}", 0, 0, rng.randrange(5, 200)) for s in ("long", "a", "b") for i in range(400)]
    total = sum(x[4] for x in full + items)
    shares = {s: sum(x[4] for x in full + items if x[0] == s) / total for s in ("long", "a", "b")}
    windows, left = packing.fill(items, shares, {}, 1000, full)
    assert windows[:50] == [[x] for x in full] and max(abs(x) for x in left.values()) < 2000
    # The source of the long texts waits until the others have what their shares are owed.
    assert not any(x[0] == "long" for w in windows[50:60] for x in w[:-2])


def test_deficits_are_carried(spark):
    """Blocks packed side by side: in block order every window keeps the shares, as if one task had packed them in a row."""
    rng = random.Random(6)
    rows = [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "d"]), rng.randrange(0, 900)) for i in range(6000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    got = packing.with_carry(sizes, 8).toPandas()
    total = sum(r[2] for r in rows)
    shares = {s: sum(r[2] for r in rows if r[1] == s) / total for s in ("hot", "a", "b", None, "d")}
    assert len(got) == 6000
    begun, worst = {}, []
    for block in range(8):
        part = got[got["block"] == block]
        for s, carry in {(packing._named(s), c) for s, c in zip(part["source"], part["carry"])}:
            assert abs(carry - (shares[s] * sum(begun.values()) - begun.get(s, 0))) < 1e-3
        out = packing._first_round(2048)((block,), part)
        windows = [[(packing._named(s), 0, 0, 0, n) for s, n in zip(g["source"], g["n_tokens"])] for _, g in out[out["kind"] == "window"].groupby("window")]
        worst += drift(windows[:-12], shares, begun)
        for s, n in zip(part["source"], part["n_tokens"]):
            begun[packing._named(s)] = begun.get(packing._named(s), 0) + n
    # A source of a block of 750 texts is off by some windows by chance; the carried credit works it off, it never adds up.
    assert sorted(worst)[len(worst) // 2] <= 2048 and sorted(worst)[int(0.95 * len(worst))] <= 2 * 2048 and max(worst) <= 6 * 2048


def test_many_sources(spark):
    """More sources than any list that was sent to the workers before held: each has its share."""
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"), F.lit(10).cast("long").alias("n_tokens"))
    out = packing.with_carry(df, 8)
    assert out.count() == 30_000 and out.agg(F.min("share") * 30_000).first()[0] > 0.999


def test_fill_edges():
    assert packing.fill([], {}, {}, 10) == ([], {})
    windows, _ = packing.fill([("a", 1, 0, 0, 10), ("z", 2, 0, 0, 10), (None, 3, 0, 0, 1)], {"a": 0.5}, {}, 10)
    assert sorted(len(w) for w in windows) == [1, 1, 1]


@needs
def test_frame(spark):
    rng = random.Random(4)
    docs = [(i, None if i == 5 else "" if i == 6 else "word " * (9000 if i == 7 else 2047 if i == 8 else 2048 if i == 9 else rng.randrange(1, 300)), "hot" if i % 3 else rng.choice(["x", None])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = packing.packed(df).collect()
    sizes = {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()}
    by_window, by_doc = {}, {}
    for r in rows:
        by_window[r.window_id] = by_window.get(r.window_id, 0) + r.n_tokens
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start_token, r.n_tokens))
    assert max(by_window.values()) <= packing.CAPACITY
    assert set(by_doc) == set(range(300))
    for d, pieces in by_doc.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum(n for _, _, n in pieces) == sizes[d]
        assert all(a == sum(n for _, _, n in pieces[:k]) for k, (_, a, _) in enumerate(pieces))
        assert len(pieces) == 1 or sizes[d] > packing.CAPACITY
    assert len(by_window) <= -(-sum(sizes.values()) // packing.CAPACITY) + 2


@needs
def test_empty_frames(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert packing.packed(df).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert packing.packed(blank).agg(F.sum("n_tokens"), F.count("*")).first() == (0, 2)
