"""Problem 3: new batches against all history, by an index of minhash signatures.

The index lies in a table in a folder and outlives the session: the shingle set and the signature of every record, in
shards that are appended. A batch is searched against the index, and its kept records are appended to it as a shard of
their own; no history is read but the index. When there are many small shards they are compacted. Every change writes new
files and then a new version of the list of shards, itself a table, so a reader or a lost executor never meets half a
change.

A search brings queries and indexed records together that agree in a band of their signatures (see ``signatures``), a round
of bands at a time, so that what is shuffled at once stays within ``ROUND`` postings, and grows with queries plus records, not
with their product. What meets is decided by the exact similarity of the sets; sets are fetched only for what met. Nothing
bounds how many candidates a query has.

A record is rejected if its set, or one similar to it, stands in the history or in an earlier record that was kept.
Only the first record of a set can be kept. The rest is decided over the links between the remaining records: a record
without an earlier similar one is kept, those similar to a kept one are rejected, and so on until all are decided.
The records kept are then searched against each other once more, by other signatures; links that come out so are added to all
links, and all records decided anew, until no new link is found.

Null questions and those with fewer than three words are similar to nothing and never rejected. Repeated deliveries
count once.

``Segment`` searches sets in the memory of one process, exactly or by a graph; no query uses it, tests compare with it.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapidary.llm import signatures, sketches
from lapidary.llm.graph import SAMPLE, Graph
from lapidary.llm.words import mix
from lapidary.session import checkpoint_folder, durable

THRESHOLD = 0.6
DIMENSIONS = 32
#: Records of a compacted shard, and shards below half of that after which they are compacted.
SEGMENT, COMPACT_AFTER = 50_000, 16
#: Postings of a round of bands, of a task of it, and records that a bucket of a band is meant for.
ROUND, TASK, BUCKET = 32_000_000, 500_000, 500_000

SHARDS = "shard string, h1 bigint, h2 bigint, shingles array<int>, signature binary"


def vector(shingles: np.ndarray) -> np.ndarray:
    """A unit vector: the sum of random signs of the set's members."""
    h = mix(shingles.astype(np.uint32).astype(np.uint64) + np.uint64(0x5BD1E995))
    signs = (h[:, None] >> np.arange(DIMENSIONS, dtype=np.uint64)[None, :]) & np.uint64(1)
    v = (2 * signs.astype(np.float32) - 1).sum(axis=0)
    n = float(np.linalg.norm(v))
    return (v / n if n else np.eye(1, DIMENSIONS, dtype=np.float32)[0]).astype(np.float32)


class Segment:
    """The nodes of a shard: names, vectors, graph and sets."""

    def __init__(self, ids, vectors: np.ndarray, members: np.ndarray, ends: np.ndarray, links: np.ndarray | None = None):
        self.ids, self.members, self.ends = ids, members, ends
        self.graph = Graph(vectors, links)
        self._lists = None

    @classmethod
    def built(cls, ids: list[str], vectors: np.ndarray, sets: list[np.ndarray]) -> Segment:
        # The graph doesn't depend on the order of delivery; long links come from a random order of insertion.
        order = np.argsort([hash_of(i) for i in ids], kind="stable")
        ends = np.cumsum([0, *[len(sets[k]) for k in order]]).astype(np.int64)
        members = np.concatenate([np.asarray(sets[k], np.int32) for k in order]) if len(order) else np.empty(0, np.int32)
        return cls([ids[k] for k in order], vectors[order], members, ends)

    def lists(self):
        """The inverted lists: distinct members, where the list of each begins, the nodes, and each member's number."""
        if self._lists is None:
            distinct, number = np.unique(self.members, return_inverse=True)
            owner = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.ends))
            order = np.argsort(number, kind="stable")
            starts = np.searchsorted(number[order], np.arange(len(distinct) + 1))
            self._lists = distinct, starts, owner[order], number.astype(np.int32)
        return self._lists

    def _known(self, of: np.ndarray) -> np.ndarray:
        distinct = self.lists()[0]
        at = np.searchsorted(distinct, of)
        at = at[at < len(distinct)]
        return at[np.isin(distinct[at], of, assume_unique=True)]

    def exact(self, of: np.ndarray, least: float) -> np.ndarray:
        """All nodes whose similarity with the set ``of`` is ``least`` or more."""
        _, starts, nodes, _ = self.lists()
        known = self._known(of)
        if not len(known):
            return np.empty(0, np.int64)
        both = np.bincount(np.concatenate([nodes[starts[k] : starts[k + 1]] for k in known]), minlength=len(self.ids))
        size = np.diff(self.ends)
        return np.flatnonzero(both >= least * (size + len(of) - both) - 1e-9)

    def similar(self, of: np.ndarray, among: np.ndarray, least: float, mark: np.ndarray) -> np.ndarray:
        """Which of ``among`` have a similarity with ``of`` of ``least`` or more; ``mark`` is a scratch of False for each distinct member."""
        number = self.lists()[3]
        known = self._known(of)
        mark[known] = True
        a, size = self.ends[among], self.ends[among + 1] - self.ends[among]
        places = np.repeat(a - np.cumsum(np.r_[0, size[:-1]]), size) + np.arange(size.sum())
        both = np.bincount(np.repeat(np.arange(len(among)), size), mark[number[places]], len(among))
        mark[known] = False
        return both >= least * (size + len(of) - both) - 1e-9

    def search(self, vectors: np.ndarray, sets: list[np.ndarray], least: float) -> list[np.ndarray]:
        """The similar nodes of every query."""
        sample = np.arange(0, len(sets), max(1, len(sets) // SAMPLE))[:SAMPLE]
        beam = self.graph.tuned_beam(vectors[sample], [self.exact(sets[i], least) for i in sample], widest=WIDEST)
        if beam is None:
            return [self.exact(s, least) for s in sets]
        mark = np.zeros(len(self.lists()[0]), bool)
        found: list[np.ndarray] = []
        for at in range(0, len(sets), 4096):
            nodes, cosines = self.graph.search(vectors[at : at + 4096], beam)
            order = np.argsort(-cosines, axis=1)
            nodes, cosines = np.take_along_axis(nodes, order, 1), np.take_along_axis(cosines, order, 1)
            many = ((cosines >= NEAR) & (nodes >= 0)).sum(axis=1)
            for i in range(len(nodes)):
                of, among = sets[at + i], nodes[i, : many[i]].astype(np.int64)
                hit = self.similar(of, among, least, mark) if len(among) else np.empty(0, bool)
                # A beam with similar nodes among its worst places may hide more of them, however many.
                crowded = nodes.shape[1] < len(self.ids) and hit[nodes.shape[1] - max(1, nodes.shape[1] // WORST) :].any()
                found.append(self.exact(of, least) if crowded else among[hit])
        return found


#: Cosine that the vectors of sets of similarity 0.6 have, but for about one in a thousand.
NEAR = 0.5
#: Beams are widened to so many nodes for the sample, and are crowded if one of the worst of so many parts of their places is similar.
WIDEST, WORST = 512, 4


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(text)


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files go as soon as the action that wrote them is over, for frames made within."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class HistoryIndex:
    """The index in ``folder``, at its latest version. Records have node (h1 and h2 as by ``_node``), h1, h2, shingles. Its signatures
    are drawn by ``seed``, which must stay the same for a folder."""

    def __init__(self, spark: SparkSession, folder: str, segment: int = SEGMENT, seed: int = 0):
        self.spark, self.folder, self.segment, self.seed = spark, folder.rstrip("/"), segment, seed
        self.version = max(self._versions(), default=-1)

    @classmethod
    def temporary(cls, spark: SparkSession, segment: int = SEGMENT, seed: int = 0) -> HistoryIndex:
        """A new index in the shared folder of the session."""
        return cls(spark, f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}", segment, seed)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, path = self._fs(f"{self.folder}/versions")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return [int(n) for n in names if n.isdigit() and fs.exists(self._fs(f"{self.folder}/versions/{n}/_SUCCESS")[1])]

    def drop(self) -> None:
        fs, path = self._fs(self.folder)
        fs.delete(path, True)

    def manifest(self) -> DataFrame | None:
        """(part, shard, n): the shards of this version; None for an empty index."""
        return None if self.version < 0 else self.spark.read.schema("part string, shard string, n bigint").parquet(f"{self.folder}/versions/{self.version}")

    def keys(self) -> DataFrame | None:
        """(h1, h2) of all sets."""
        return None if self.version < 0 else self._live().select("h1", "h2")

    def _commit(self, manifest: DataFrame) -> None:
        durable(manifest.select("part", "shard", "n")).coalesce(1).write.parquet(f"{self.folder}/versions/{self.version + 1}")
        self.version += 1

    def _written(self, rows: DataFrame) -> DataFrame:
        """The manifest of a new part with ``rows``, whose column shard names their shards."""
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/shards/{part}")
        sizes = self.spark.read.schema(SHARDS).parquet(f"{self.folder}/shards/{part}").groupBy("shard").agg(F.count("*").alias("n"))
        return durable(sizes.select(F.lit(part).alias("part"), "shard", "n"))

    def append(self, records: DataFrame, by: str | None = None) -> None:
        """Index ``records`` as one shard, or one for each value of ``by``."""
        with tidy(self.spark):
            value = F.coalesce(F.col(by).cast("string"), F.lit("none")) if by else F.lit("all")
            new = self._written(signatures.signed(records.select(value.alias("shard"), "h1", "h2", "shingles"), self.seed))
            if new.isEmpty():
                return
            old = self.manifest()
            self._commit(new if old is None else old.union(new))
            if self.manifest().where(F.col("n") < self.segment / 2).count() > COMPACT_AFTER:
                self.compact()

    def _live(self) -> DataFrame:
        """The records of this version with part and shard."""
        manifest = self.manifest().select("part", "shard")
        # One name for each append since the last compaction, and for each that was too large for it.
        parts = sorted(r.part for r in manifest.select("part").distinct().collect())
        rows = self.spark.read.schema(SHARDS).parquet(*[f"{self.folder}/shards/{p}" for p in parts])
        return rows.withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -2)).join(F.broadcast(manifest), ["part", "shard"], "left_semi")

    def compact(self) -> None:
        """Merge small shards; large ones stay as they are."""
        with tidy(self.spark):
            manifest = durable(self.manifest())
            small = manifest.where(F.col("n") < self.segment / 2)
            so_far = F.sum("n").over(Window.orderBy("part", "shard"))  # a row for each small shard
            target = small.select("part", "shard", F.concat(F.lit("compacted/"), F.floor((so_far - 1) / F.lit(self.segment)).cast("string")).alias("target"))
            rows = self._live().join(F.broadcast(target), ["part", "shard"]).select(F.col("target").alias("shard"), *[c.split()[0] for c in SHARDS.split(", ")[1:]])
            merged = self._written(rows.repartition("shard"))
            self._commit(manifest.where(F.col("n") >= self.segment / 2).union(merged))

    def search(self, queries: DataFrame, least: float = THRESHOLD) -> DataFrame:
        """(query, node): the indexed records whose sets are similar to those of the queries (node, shingles)."""
        with tidy(self.spark):
            own = queries.select(F.xxhash64("node").alias("id"), F.col("node").alias("query"), "shingles")
            signed = durable(signatures.signed(own.select("id", "shingles"), self.seed).select("id", "signature"))
            index = self._live().select(F.xxhash64(_node("h1", "h2")).alias("id"), _node("h1", "h2").alias("node"), F.col("shingles").alias("of_node"), "signature")
            many = signed.count() + self.manifest().agg(F.sum("n")).first()[0]
            splits, rounds = -(-many // BUCKET), min(signatures.BANDS, -(-many * signatures.BANDS // ROUND))
            rows = []
            for r in range(rounds):
                bands = range(r, signatures.BANDS, rounds)
                postings = signatures.posted(signed, True, bands, splits, self.seed).union(signatures.posted(index, False, bands, splits, self.seed))
                slots = -(-many * len(bands) // TASK)
                placed = _placed(postings.withColumn("slot", F.pmod("bucket", F.lit(slots))), slots).repartition(slots, "key")
                rows.append(durable(signatures.met(placed, splits).distinct()))
            pairs = rows[0]
            for more in rows[1:]:
                pairs = pairs.union(more)
            pairs = durable(pairs.distinct())
            met = signatures.hinted(index.drop("signature"), "id", pairs.select("node_id").distinct())
            both = pairs.join(own.withColumnRenamed("id", "query_id"), "query_id").join(met.withColumnRenamed("id", "node_id"), "node_id")
            return both.where(sketches.similarity("shingles", "of_node") >= least - 1e-9).select("query", "node")


def _placed(df: DataFrame, slots: int) -> DataFrame:
    """``df`` with a column key in place of slot (0 to ``slots`` - 1), by which ``repartition(slots, "key")`` puts every slot into a
    partition of its own. Slots are few and heavy, so two in one task would cost as much again."""
    spark = df.sparkSession
    keys = spark.range(64 * slots).select(F.col("id").alias("key"), F.pmod(F.hash("id"), F.lit(slots)).cast("bigint").alias("slot")).groupBy("slot").agg(F.min("key").alias("key"))
    return df.withColumn("slot", F.col("slot").cast("bigint")).join(F.broadcast(keys), "slot").drop("slot")


def _node(*columns: str):
    return F.concat_ws(":", *[F.col(c).cast("string") for c in columns])


def decided(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected), one column node each, of all records in ``links`` (query, node: the earlier one)."""
    links = durable(links)
    undecided = durable(links.select(F.col("query").alias("node")).distinct())
    kept = links.select("node").distinct().join(undecided, "node", "left_anti")
    rejected = undecided.limit(0)
    while not undecided.isEmpty():
        gone = links.join(kept, "node", "left_semi").select(F.col("query").alias("node")).distinct()
        rejected = durable(rejected.union(undecided.join(gone, "node", "left_semi")))
        rest = undecided.join(rejected, "node", "left_anti")
        waiting = links.join(rejected, "node", "left_anti").select(F.col("query").alias("node")).distinct()
        kept = durable(kept.union(rest.join(waiting, "node", "left_anti")))
        undecided = durable(rest.join(waiting, "node", "left_semi"))
    return kept, rejected


def settled(links: DataFrame, again) -> DataFrame:
    """The rejected nodes when no new link is left; ``again(rejected)`` gives the links found among all other records.

    New links join all links and everything is decided from the start, as a record that is rejected by them rejects no other.
    """
    links = durable(links)
    while True:
        _, rejected = decided(links)
        # Records that are kept have no known link among each other, so each of these is new.
        more = durable(again(rejected))
        if more.isEmpty():
            return rejected
        links = durable(links.union(more))


def screened(index: HistoryIndex, batches: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(batch_no, rec_id) of the rejected records of ``batches`` (batch_no, rec_id, question); the others are appended to
    ``index``, a shard for each batch."""
    with tidy(index.spark):
        rows = batches.select("batch_no", "rec_id", "question").distinct()
        own = durable(sketches.with_sets(rows, ["batch_no", "rec_id"], F.col("question")))
        first = own.groupBy("h1", "h2").agg(F.min(F.struct("batch_no", "rec_id")).alias("first"), F.any_value("shingles").alias("shingles"))
        first = first.select("first.batch_no", "first.rec_id", "h1", "h2", "shingles").withColumn("node", _node("h1", "h2"))
        if (keys := index.keys()) is not None:
            first = durable(first.join(keys, ["h1", "h2"], "left_anti"))
            known = durable(index.search(first, threshold).select(F.col("query").alias("node")).distinct())
            remaining = first.join(known, "node", "left_anti")
        else:
            remaining = first = durable(first)
        order = remaining.select("node", F.struct("batch_no", "rec_id").alias("at"))
        seeds = iter(range(1, 1 << 20))

        def links(among: DataFrame) -> DataFrame:
            """The similar records of ``among``, (query, node: the earlier one)."""
            small = HistoryIndex.temporary(index.spark, index.segment, next(seeds))
            small.append(among)
            if small.version < 0:
                return order.limit(0).select(F.col("node").alias("query"), "node")
            pairs = small.search(among, threshold).where("query <> node")
            placed = pairs.join(order.withColumnsRenamed({"node": "query", "at": "of_query"}), "query").join(order.withColumnRenamed("at", "of_node"), "node")
            later = F.col("of_query") > F.col("of_node")
            out = durable(placed.select(F.when(later, F.col("query")).otherwise(F.col("node")).alias("query"), F.when(later, F.col("node")).otherwise(F.col("query")).alias("node")).distinct())
            small.drop()
            return out

        rejected = durable(settled(links(remaining), lambda gone: links(remaining.join(gone, "node", "left_anti"))))
        kept = remaining.join(rejected, "node", "left_anti")
        index.append(kept, "batch_no")
        return own.select("batch_no", "rec_id").join(kept.select("batch_no", "rec_id"), ["batch_no", "rec_id"], "left_anti").distinct()


def history_index(spark: SparkSession, history: list[DataFrame], folder: str | None = None, segment: int = SEGMENT) -> HistoryIndex:
    """A new index over the history frames, each with question."""
    with tidy(spark):
        index = HistoryIndex(spark, folder, segment) if folder else HistoryIndex.temporary(spark, segment)
        past = None
        for h in history:
            s = sketches.with_sets(h.select("question"), [], F.col("question"))
            past = s if past is None else past.union(s)
        past = past.groupBy("h1", "h2").agg(F.any_value("shingles").alias("shingles"))
        index.append(past)
        return index


def rejected_records(batches: DataFrame, history: list[DataFrame], threshold: float = THRESHOLD, segment: int = SEGMENT) -> DataFrame:
    """(batch_no, rec_id) of the rejected records, against a new index over the history frames."""
    index = history_index(batches.sparkSession, history, None, segment)
    rejected = screened(index, batches, threshold)
    index.drop()
    return rejected
