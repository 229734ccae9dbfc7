"""Problem 4: near-duplicates with small edits, by a chosen-path join over shingle sets.

Rows with the same set form a class; only one row of each class is joined. Each of several runs sends a set along
paths: at every node of a path two minhash coordinates are drawn (by a hash of the path, the same for all sets) and
the set goes on to the buckets of its values there. Every depth of a run draws from coordinates of its own, so a split
never repeats one that the path has behind it, and runs begin with coordinates that no other run begins with. A bucket of
at most ``SMALL`` sets is compared by brute force, behind a filter on sketches; larger ones are split on, to ``DEPTH``
splits. What is still together then agrees in a coordinate of every depth and is compared in blocks, block against block,
so nothing is dropped. Pairs are confirmed by the similarity of their sets.

A pair of similarity s survives a node with probability 1 - (1 - s p)^2, p being that of the next node; ``runs`` is
the number of runs after which a pair at the threshold is found with the target recall.

Sets hold 32-bit hashes of shingles, and classes are told by two 64-bit sums over them, so similarities and classes are
exact but for collisions of these hashes (one shingle in four billion, one class in 2^128).

Texts with fewer than three words have no set and no pair. Repeated deliveries of an id count once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapidary.llm import sketches
from lapidary.operators.joins import split_join
from lapidary.session import durable

THRESHOLD, RECALL = 0.6, 0.995
SMALL, DEPTH = 64, 8
#: Coordinates that a depth of a run draws from.
GROUP = sketches.COORDINATES // DEPTH


def survival(similarity: float, depth: int) -> float:
    """Probability that a pair shares a bucket after ``depth`` splits of one run."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - similarity * p) ** 2
    return p


def runs_for(threshold: float, recall: float, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth)))


def _drawn(path, run, depth: int):
    """The two coordinates of a node, of the group of its run and depth."""
    base = run * (GROUP + 1) + GROUP * depth
    one = F.pmod(F.xxhash64(path, F.lit(1)), F.lit(GROUP))
    two = F.pmod(one + 1 + F.pmod(F.xxhash64(path, F.lit(2)), F.lit(GROUP - 1)), F.lit(GROUP))
    return [F.pmod(base + x, F.lit(sketches.COORDINATES)).cast("int") for x in (one, two)]


def _steps(depth: int):
    """The paths (run, path) on which a set at ``path`` goes on."""
    return F.array(*[F.struct("run", F.xxhash64("path", c, F.get("coordinates", c)).alias("path")) for c in _drawn(F.col("path"), F.col("run"), depth)])


def _compared(rows: DataFrame, bits: int) -> DataFrame:
    """Candidate pairs (a, b) of rows that share a path; buckets beyond SMALL are laid out in cells of two blocks."""
    blocks = F.ceil(F.col("n") / F.lit(SMALL)).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(17)), F.col("blocks")).cast("int")
    cells = rows.withColumn("blocks", blocks).withColumn("own", own)
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("path", "rep", "s1", "s2", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    joined = cells.alias("a").join(cells.alias("b"), ["path", "x", "y"])
    inside = (F.col("a.own") == F.col("x")) & (F.col("b.own") == F.col("y")) & (F.col("a.rep") != F.col("b.rep"))
    inside &= (F.col("x") < F.col("y")) | (F.col("a.rep") < F.col("b.rep"))
    joined = joined.where(inside & (sketches.differing_bits("a", "b") <= bits))
    return joined.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b"))


def similar_classes(reps: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(a, b) with a < b of all representatives whose sets are similar.

    ``reps`` has rep, coordinates, s1, s2, once each; ``sets`` has rep and shingles, at least once. No two steps lead to
    the same path, so a set has no path twice.
    """
    runs, bits = runs_for(threshold, recall), sketches.most_differing(threshold)
    begun = reps.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).withColumn("path", F.col("run").cast("bigint"))
    level = begun.select("rep", "s1", "s2", F.explode(_steps(0)).alias("to")).select("rep", "s1", "s2", "to.*")
    found = None
    for depth in range(1, DEPTH + 1):
        n = level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        shared = durable(split_join(level, n, ["path"], "inner"))
        last = depth == DEPTH
        part = _compared(shared if last else shared.where(F.col("n") <= SMALL), bits)
        found = part if found is None else found.union(part)
        big = shared.where(F.col("n") > SMALL)
        if last or big.isEmpty():
            break
        on = big.select("path", "run", "rep", "s1", "s2").join(reps.select("rep", "coordinates"), "rep")
        level = on.select("rep", "s1", "s2", F.explode(_steps(depth)).alias("to")).select("rep", "s1", "s2", "to.*")
    pairs = found.distinct()
    exact = pairs.join(sets.withColumnsRenamed({"rep": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"rep": "b", "shingles": "sb"}), "b")
    return exact.where(sketches.similarity("sa", "sb") >= threshold).select("a", "b").distinct()


def near_duplicates(df: DataFrame, key: str, text, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the class of every row with a set (id, rep), and the similar pairs of classes (a, b)."""
    rows = durable(sketches.sketched(df.select(F.col(key).cast("string").alias("id"), text.alias("text")), ["id"], F.col("text")))
    first = rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    members = durable(split_join(rows.select("id", "h1", "h2"), first, ["h1", "h2"], "inner").select("id", "rep").distinct())
    slim = rows.select(F.col("id").alias("rep"), "coordinates", "s1", "s2").join(first.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    sets = rows.select(F.col("id").alias("rep"), "shingles")
    return members, similar_classes(durable(slim), sets, threshold, recall)


def near_pairs(df: DataFrame, key: str, text, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id_a, id_b) with id_a < id_b of all similar rows: pairs of classes and pairs within a class, spelt out."""
    members, pairs = near_duplicates(df, key, text, threshold, recall)
    a, b = members.withColumnsRenamed({"id": "ia", "rep": "a"}), members.withColumnsRenamed({"id": "ib", "rep": "b"})
    across = split_join(split_join(a, pairs, ["a"], "inner"), b, ["b"], "inner").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    within = members.alias("x").join(members.alias("y"), "rep").where("x.id < y.id").select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    return across.union(within)


def near_groups(df: DataFrame, key: str, text, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, class_id, n_links) of every row with a set: its class and the number of classes similar to it."""
    members, pairs = near_duplicates(df, key, text, threshold, recall)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    return members.join(links, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
