import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapidary.llm import history
from lapidary.llm.graph import Graph
from lapidary.llm.words import jaccard, shingles
from tests.llm.test_near import corpus

BATCH = "batch_no int, rec_id string, question string, node string"


def test_graph_recall():
    rng = np.random.RandomState(1)
    v = rng.normal(size=(5000, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = v[:500] + 0.1 * rng.normal(size=(500, 24)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    g = Graph(v)
    true = (q @ v.T).argmax(axis=1)
    ids, sims = g.search(q, 64)
    assert (ids == true[:, None]).any(axis=1).mean() >= 0.95
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in ids)
    again = Graph(v, g.links)
    assert (again.search(q, 64)[0] == ids).all()
    beam = g.tuned_beam(q, [np.array([t]) for t in true])
    assert beam is not None and (g.search(q, beam)[0] == true[:, None]).any(axis=1).mean() >= 0.95


@pytest.mark.parametrize("n", [1, 2, 50])
def test_small_graphs(n):
    v = np.eye(n, 24, dtype=np.float32) + 0.01
    ids, _ = Graph(v).search(v, 64)
    assert (ids[:, :1] >= 0).all() and ids.shape == (n, min(64, n))


def brute(batches, past, least=0.6):
    kept = [shingles(t) for t in past]
    out = set()
    for b, r, q in sorted(set(batches)):
        s = shingles(q)
        if len(s) and any(jaccard(s, k) >= least for k in kept):
            out.add((b, r))
        else:
            kept.append(s)
    return out


def test_against_brute_force(spark):
    rows = [t for _, t in corpus(11, 600)]
    rng = random.Random(1)
    past, rest = rows[:300], rows[300:]
    batches = [(rng.randrange(1, 5), f"b{i:04d}", t) for i, t in enumerate(rest)] + [(2, "same", past[0].upper())]
    batches += batches[:5]
    true = brute(batches, past)
    df = spark.createDataFrame([(*b, "x") for b in batches], BATCH)
    h = spark.createDataFrame([(t,) for t in past], "question string")
    got = [(r.batch_no, r.rec_id) for r in history.rejected_records(df, [h, h.limit(3)]).collect()]
    assert len(got) == len(set(got)) and len(true) > 100
    assert len(true & set(got)) >= 0.98 * len(true) and len(set(got) - true) <= 0.02 * len(true)


def test_segments_and_compaction(spark, monkeypatch):
    monkeypatch.setattr(history, "COMPACT_AFTER", 3)
    rows = [t for _, t in corpus(12, 300)]
    batches = [(i % 6, f"b{i:04d}", t) for i, t in enumerate(rows[150:])]
    true = brute(batches, rows[:150])
    df = spark.createDataFrame([(*b, "x") for b in batches], BATCH)
    h = spark.createDataFrame([(t,) for t in rows[:150]], "question string")
    got = {(r.batch_no, r.rec_id) for r in history.rejected_records(df, [h], segment=60).collect()}
    assert len(true & got) >= 0.98 * len(true) and len(got - true) <= 0.03 * len(true)


def test_edges(spark):
    rows = [(1, "a", None), (1, "b", ""), (1, "c", "two words"), (1, "d", "w1 w2 w3 w4"), (1, "e", "W1, w2 w3 w4."), (2, "a", "w1 w2 w3 w4"), (2, "b", "other words stand here")]
    df = spark.createDataFrame([(*r, "x") for r in rows], BATCH)
    empty = spark.createDataFrame([], "question string")
    assert {(r.batch_no, r.rec_id) for r in history.rejected_records(df, [empty]).collect()} == {(1, "e"), (2, "a")}
    assert history.rejected_records(df.limit(0), [empty]).count() == 0
    known = spark.createDataFrame([("other words stand here",), (None,)], "question string")
    assert {(r.batch_no, r.rec_id) for r in history.rejected_records(df, [known]).collect()} == {(1, "e"), (2, "a"), (2, "b")}


def test_every_slot_has_its_own_partition(spark):
    df = spark.range(400).select(F.col("id"), F.pmod(F.col("id"), F.lit(23)).alias("slot"), F.pmod(F.col("id"), F.lit(23)).alias("s"))
    placed = history._placed(df, 23).repartition(23, "key").select("s", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(placed) == 23 == len({r.p for r in placed})


def test_decided(spark):
    # c is near b and b near a: b is rejected, so c is kept.
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("d", "b"), ("e", "a")], "query string, node string")
    kept, rejected = history.decided(links)
    assert sorted(r.node for r in kept.collect()) == ["a", "c"] and sorted(r.node for r in rejected.collect()) == ["b", "d", "e"]


def unit(v):
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_crowds():
    # Far more similar nodes than any beam holds: the exact lists give all of them, and those of a query without a crowd.
    rng = np.random.RandomState(3)
    lone = [rng.randint(0, 1 << 30, 40).astype(np.int32) for _ in range(3000)]
    base = np.arange(40, dtype=np.int32)
    crowd = [np.unique(np.r_[base[rng.rand(40) < 0.95], rng.randint(1 << 20, 1 << 30, 1)]).astype(np.int32) for _ in range(2000)]
    sets = [np.unique(s) for s in lone + crowd]
    vectors = np.stack([history.vector(s) for s in sets])
    segment = history.Segment.built([f"n{i}" for i in range(len(sets))], vectors, sets)
    queries = [base, sets[5], np.unique(np.r_[sets[7][:30], np.arange(90, 96, dtype=np.int32)]), np.array([-5], np.int32)] + [sets[i] for i in range(100, 116)]
    found = segment.search(np.stack([history.vector(q) for q in queries]), queries, 0.6)
    true = [{f"n{i}" for i, s in enumerate(sets) if len(np.intersect1d(q, s)) >= 0.6 * (len(q) + len(s) - len(np.intersect1d(q, s)))} for q in queries]
    got = [{segment.ids[k] for k in f} for f in found]
    assert len(true[0]) > 1900 and got[0] == true[0] and got[3] == set()
    assert all(g <= t for g, t in zip(got, true)) and sum(map(len, got)) >= 0.99 * sum(map(len, true))
    assert all({segment.ids[k] for k in segment.exact(q, 0.6)} == t for q, t in zip(queries, true))


def test_links_found_late(spark, monkeypatch):
    # The first search finds only that c is near b; that b is near a, and e near d, comes out when the kept are searched again.
    texts = {"a": "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10", "b": "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12", "c": "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16", "d": "v1 v2 v3 v4 v5", "e": "v1 v2 v3 v4 v5 v6"}
    rows = [(1, k, t) for k, t in texts.items()]
    assert brute(rows, []) == {(1, "b"), (1, "e")}
    searches, search = [], history.HistoryIndex.search

    def partly(self, queries, least=history.THRESHOLD):
        searches.append(queries.count())
        pairs = search(self, queries, least)
        q = queries.select("node", F.size("shingles").alias("many"))
        both = pairs.join(q.withColumnRenamed("node", "query"), "query").join(q.withColumnRenamed("many", "of_node"), "node")
        # Sets of 10 and 14 members are b and c.
        return (both.where("many in (10, 14) and of_node in (10, 14)") if len(searches) == 1 else both).select("query", "node")

    monkeypatch.setattr(history.HistoryIndex, "search", partly)
    df = spark.createDataFrame([(*r, "x") for r in rows], BATCH)
    got = {(r.batch_no, r.rec_id) for r in history.rejected_records(df, [spark.createDataFrame([], "question string")]).collect()}
    assert got == {(1, "b"), (1, "e")} and searches == [5, 4, 3]


def test_index_outlives_the_history(spark, tmp_path, monkeypatch):
    """Batches that come later are screened by the index alone: the history's files are gone by then."""
    monkeypatch.setattr(history, "COMPACT_AFTER", 2)
    rows = [t for _, t in corpus(21, 400)]
    batches = [(i // 70, f"b{i:04d}", t) for i, t in enumerate(rows[200:])]
    true = brute(batches, rows[:200])
    files = str(tmp_path / "history.parquet")
    spark.createDataFrame([(t,) for t in rows[:200]], "question string").write.parquet(files)
    folder = str(tmp_path / "index")
    history.history_index(spark, [spark.read.parquet(files)], folder, segment=100)
    shutil.rmtree(files)
    got, versions = set(), []
    for b in range(3):
        index = history.HistoryIndex(spark, folder, segment=100)
        versions.append(index.version)
        df = spark.createDataFrame([(*r, "x") for r in batches if r[0] == b], BATCH)
        got |= {(r.batch_no, r.rec_id) for r in history.screened(index, df).collect()}
        used = {f for f in index._live().inputFiles()}
        assert used and all("/index/" in f for f in used)
    index = history.HistoryIndex(spark, folder, segment=100)
    assert versions == sorted(versions) and versions[0] == 0 and index.version > 3  # compactions are versions, too
    assert index.manifest().where("shard like 'compacted%'").count() and index.manifest().agg(F.sum("n")).first()[0] == index.keys().distinct().count()
    assert len(true & got) >= 0.98 * len(true) and len(got - true) <= 0.02 * len(true) and len(true) > 30


def test_recall_of_every_hundredth(spark, data):
    """Every row of the tables whose number ends in 00, against all rows, by brute force over inverted lists."""
    base = data.replace("sf0.001", "sf0.1")
    h = spark.read.parquet(f"{base}/puzzles.parquet").select("question").union(spark.read.parquet(f"{base}/final_records.parquet").select("question"))
    index = history.history_index(spark, [h])
    past = [history.sketches.shingle_set(r.question)[2] for r in h.distinct().collect() if history.sketches.shingle_set(r.question)]
    sets = sorted({tuple(s.tolist()) for s in past})
    everything = history.Segment([str(i) for i in range(len(sets))], np.zeros((len(sets), 32), np.float32), np.concatenate([np.array(s, np.int32) for s in sets]), np.cumsum([0, *map(len, sets)]), np.full((len(sets), history.Graph(np.zeros((1, 32))).links.shape[1]), -1, np.int32))
    q = [(str(i), [int(x) for x in sets[i]]) for i in range(0, len(sets), 100)]
    true = {(i, len(everything.exact(np.array(s, np.int32), 0.6))) for i, s in q}
    df = spark.createDataFrame(q, "node string, shingles array<int>")
    counts = {r["query"]: r["count"] for r in index.search(df).groupBy("query").count().collect()}
    assert sum(min(counts.get(i, 0), n) for i, n in true) >= 0.95 * sum(n for _, n in true)
    assert all(counts.get(i, 0) <= n for i, n in true)


def test_a_search_does_not_grow_with_the_shards(spark):
    """Every query was sent to every shard, and every shard to every block of queries: 20 shards took twenty times the disk."""
    rng = np.random.RandomState(5)
    rows = [(f"{i}:{i}", i, i, i % 20, [int(x) for x in np.unique(rng.randint(0, 1 << 30, 60))]) for i in range(2000)]
    df = spark.createDataFrame(rows, "node string, h1 bigint, h2 bigint, batch_no int, shingles array<int>").cache()
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    written = lambda: sum(e.totalShuffleWrite() for e in map(store.executorList(True).apply, range(store.executorList(True).size())))
    store, took = spark.sparkContext._jsc.sc().statusStore(), []
    for by in (None, "batch_no"):
        index = history.HistoryIndex.temporary(spark, segment=100 if by else 100_000)
        index.append(df, by)
        assert index.manifest().count() == (20 if by else 1)
        before = written()
        got = index.search(df.select("node", "shingles"))
        assert {(r.query, r.node) for r in got.collect()} == {(r[0], r[0]) for r in rows}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        took.append(written() - before)
        index.drop()
    df.unpersist()
    assert 0 < took[1] < 1.5 * took[0]
    # What the actions shuffled doesn't stay.
    files = env.blockManager().diskBlockManager().getAllFiles()
    kept = {files.apply(i).getName() for i in range(files.size())}
    history.rejected_records(spark.createDataFrame([(1, "a", "w1 w2 w3 w4 w5"), (1, "b", "w1 w2 w3 w4 w5 w6")], "batch_no int, rec_id string, question string"), [spark.createDataFrame([("v1 v2 v3 v4",)], "question string")]).collect()
    files = env.blockManager().diskBlockManager().getAllFiles()
    assert not [n for n in {files.apply(i).getName() for i in range(files.size())} - kept if n.startswith("shuffle_")]


def test_signatures_find_similar_sets():
    # Pairs of similarity 0.6, 0.7 and 0.9: most meet in a band and pass the check, and hardly any others do.
    rng = np.random.RandomState(9)
    signatures = history.signatures
    for share, least in ((0.6, 0.97), (0.7, 0.995), (0.9, 1.0)):
        own, other = [], []
        for _ in range(2000):
            x = rng.randint(0, 1 << 30, 100).astype(np.int32)
            both, rest = int(100 * share), 100 - int(100 * share)
            own.append(np.unique(x[: both + rest // 2]))
            other.append(np.unique(np.r_[x[:both], x[both + rest // 2 :]]))
        a, b = (signatures.signatures(np.concatenate(s), np.cumsum([0, *map(len, s)])) for s in (own, other))
        met = np.zeros(2000, bool)
        for band in range(signatures.BANDS):
            ha, hb = signatures.band_hashes(a, band), signatures.band_hashes(b, band)
            met |= ha == hb
            assert (ha == np.roll(hb, 1)).mean() < 0.001
        met &= (a[:, : signatures.CHECKED] == b[:, : signatures.CHECKED]).sum(axis=1) >= signatures.LEAST
        assert met.mean() >= least
