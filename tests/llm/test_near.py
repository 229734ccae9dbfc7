import random

import pytest
from pyspark.sql import functions as F

from lapidary.llm import near, sketches
from lapidary.llm.words import jaccard, shingles

SCHEMA = "id string, text string"


def edited(rng, words):
    w = list(words)
    for _ in range(rng.randrange(0, 4)):
        k = rng.randrange(len(w))
        kind = rng.randrange(3)
        if kind == 0:
            w[k] = f"new{rng.randrange(1000)}"
        elif kind == 1:
            del w[k]
        else:
            w.insert(k, f"ins{rng.randrange(1000)}")
    return w


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(200)]
    base, rows = [], []
    for i in range(n):
        w = edited(rng, rng.choice(base)) if base and rng.random() < 0.5 else rng.choices(vocab, k=rng.randrange(8, 60))
        base.append(w)
        rows.append((f"r{i:04d}", " ".join(w)))
    return rows


def brute(rows, least):
    s = {i: shingles(t) for i, t in rows}
    ids = sorted(s)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if jaccard(s[a], s[b]) >= least}


def found(df):
    return [(r.id_a, r.id_b) for r in df.collect()]


def test_recall(spark):
    rows = corpus(1, 400)
    true = brute(rows, 0.6)
    got = found(near.near_pairs(spark.createDataFrame(rows, SCHEMA), "id", F.col("text")))
    assert len(got) == len(set(got)) and set(got) <= true
    assert len(true & set(got)) >= 0.985 * len(true) and len(true) > 100


def test_hot_group(spark, monkeypatch):
    """A third of the rows edits of one text, so that buckets never get small: blocks give every pair."""
    monkeypatch.setattr(near, "SMALL", 8)
    rng = random.Random(2)
    text = [f"w{i}" for i in range(300)]
    rows = [(f"h{i:03d}", " ".join([*text, f"x{i}"])) for i in range(60)] + [(f"o{i:03d}", " ".join(rng.choices(text, k=40))) for i in range(120)]
    true = brute(rows, 0.6)
    got = found(near.near_pairs(spark.createDataFrame(rows, SCHEMA), "id", F.col("text")))
    assert len(true) >= 60 * 59 // 2 and set(got) == true and len(got) == len(true)


def test_edges(spark):
    rows = [("a", "one two three"), ("b", "One, two - three!"), ("c", "one two"), ("d", None), ("e", ""), ("f", "x y z"), ("a", "one two three")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(near.near_pairs(df, "id", F.col("text"))) == [("a", "b")]
    groups = {(r.id, r.class_id, r.n_links) for r in near.near_groups(df, "id", F.col("text")).collect()}
    assert groups == {("a", "a", 0), ("b", "a", 0), ("f", "f", 0)}
    assert found(near.near_pairs(df.limit(0), "id", F.col("text"))) == []


def test_runs():
    assert near.survival(1.0, 1) == 1.0
    p = near.survival(0.6, near.DEPTH)
    assert 1 - (1 - p) ** near.runs_for(0.6, 0.995) >= 0.995


@pytest.mark.parametrize("share", [0.0, 0.6, 1.0])
def test_sketches(share):
    rng = random.Random(5)
    n, differ = 40, 0
    for k in range(n):
        common = [f"c{k}_{i}" for i in range(int(200 * 2 * share / (1 + share)))]
        a = sketches.sketch(" ".join(common + [f"a{k}_{i}" for i in range(202 - len(common))]))
        b = sketches.sketch(" ".join(common + [f"b{k}_{i}" for i in range(202 - len(common))]))
        differ += sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a[4:], b[4:]))
    assert abs(differ / n / 128 - (1 - share) / 2) < 0.05 and rng


def test_drawn_coordinates(spark):
    """No path draws a coordinate twice, and runs begin with different ones."""
    df = spark.range(200).select(F.xxhash64("id").alias("path"), F.pmod(F.col("id"), F.lit(6)).cast("int").alias("run"))
    drawn = [{(r.path, r.run): {r.a, r.b} for r in df.select("path", "run", *[c.alias(n) for c, n in zip(near._drawn(F.col("path"), F.col("run"), d), "ab")]).collect()} for d in range(near.DEPTH)]
    for key in drawn[0]:
        assert all(len(d[key]) == 2 for d in drawn) and len(set().union(*[d[key] for d in drawn])) == 2 * near.DEPTH
    first = {}
    for (_, run), pair in drawn[0].items():
        first.setdefault(run, set()).update(pair)
    assert sum(map(len, first.values())) == len(set().union(*first.values()))


def test_crowd_is_split_before_it_is_compared(spark, monkeypatch):
    """Texts that share a third of their shingles fill one bucket after the first split; deeper splits part them."""
    monkeypatch.setattr(near, "SMALL", 16)
    rng = random.Random(4)
    common = [f"c{i}" for i in range(40)]
    rows = [(f"k{i:04d}", " ".join(common + [f"x{i}_{j}" for j in range(80)])) for i in range(400)]
    rows += [(f"l{i:04d}", rows[i][1] + " more words here") for i in range(0, 400, 4)] + [(f"o{i}", " ".join(rng.choices(common, k=30))) for i in range(100)]
    seen = []
    compared = near._compared

    def counted(rows, bits):
        seen.append(rows.agg(F.sum(F.ceil(F.col("n") / F.lit(16)))).first()[0] or 0)
        return compared(rows, bits)

    monkeypatch.setattr(near, "_compared", counted)
    got = found(near.near_pairs(spark.createDataFrame(rows, SCHEMA), "id", F.col("text")))
    true = brute(rows, 0.6)
    assert set(got) <= true and len(true & set(got)) >= 0.98 * len(true) >= 98
    assert len(seen) > 2
