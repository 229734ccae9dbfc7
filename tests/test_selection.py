import random

import pytest
from pyspark.sql import functions as F

from lapidary.operators import selection
from lapidary.functions.solvers import solve_sudoku


def one(spark, column, schema, row):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(("features", "target", "ok"), [({"a": "1"}, {"a": "1"}, True), ({"a": "1"}, {"a": "2"}, False), ({"a": "1"}, {"b": "2"}, True), ({"_a": "1"}, {"_a": "2"}, True), ({}, {}, True)])
def test_matches(spark, features, target, ok):
    assert one(spark, selection.matches(F.col("f"), F.col("t")), "f map<string,string>, t map<string,string>", (features, target)) is ok


def test_arrays_and_maps(spark):
    assert [tuple(x) for x in one(spark, selection.zipped(F.col("a"), F.col("b")), "a array<int>, b array<string>", ([1, 2, 3], ["x", "y"]))] == [(1, "x"), (2, "y")]
    assert one(spark, selection.zipped(F.col("a"), F.col("b")), "a array<int>, b array<string>", ([], ["x"])) == []
    assert [tuple(x) for x in one(spark, selection.top_of_map(F.col("m"), 2), "m map<string,int>", ({"b": 2, "a": 2, "c": 5},))] == [("c", 5), ("a", 2)]
    assert [one(spark, selection.tiled(["x", "y"], F.col("n")), "n int", (n,)) for n in (0, 1, 3)] == [[], ["x"], ["x", "y", "x"]]


@pytest.mark.parametrize(("pattern", "value", "ok"), [("a*", "abc", True), ("a?c", "abc", True), ("a?c", "ac", False), ("a.c", "abc", False), ("*", "", True), ("a", "ab", False)])
def test_glob(spark, pattern, value, ok):
    assert one(spark, F.col("v").rlike(selection.glob(pattern)), "v string", (value,)) is ok


def test_feedback(spark):
    f = one(spark, selection.feedback("t"), "t string", ("我喜欢难一点的数学题，给我2道24点",))
    changes = [tuple(x) for x in f.changes]
    assert f.difficulty == "hard" and ("tag", "math", 2) in changes and ("rule", "10", 3) in changes and ("tag", "math", 1) in changes
    none = one(spark, selection.feedback("t"), "t string", ("",))
    assert none.difficulty is None and none.changes == []


def test_profile_text(spark):
    rules, tags = {str(i): i for i in range(1, 26)}, {"math": 10, "word": 8}
    text = one(spark, selection.profile_text(F.lit("u"), F.lit("hard"), F.col("r"), F.col("t"), 120), "r map<string,int>, t map<string,int>", (rules, tags))
    assert len(text) <= 120 and "difficulty_preference=hard" in text and "R25:25" in text


def test_jobs(spark):
    rows = [("a", 0, "GENERATE", "10", 2), ("a", 1, "GENERATE", "99", 5), ("a", 2, "GENERATE", "10", 4), ("b", 0, "HELP", None, None), ("c", 0, "GENERATE", "77", 1)]
    df = spark.createDataFrame(rows, "k string, position int, action string, rule_id string, count int")
    got = {r.k: (r.rules, r["count"]) for r in selection.jobs(df, "k", ["10", "15"]).collect()}
    assert got == {"a": (["10"], 4), "c": (["10", "15"], 1)}


def test_registry(spark):
    reg = spark.createDataFrame([("v1", {"generator": "g"})], "version_id string, prompts map<string,string>")
    assert selection.version_or_builtin(reg, "v1", {"generator": "x"}).first().prompts == {"generator": "g"}
    assert selection.version_or_builtin(reg, "v2", {"generator": "x"}).first().version_id == "builtin"


def test_free_digits(spark):
    solved = [int(c) for row in solve_sudoku("53..7....6..195....98....6.8...6...34..8.3..17...2...6.6....28....419..5....8..79")["solution"].split(",") for c in row.split()]
    for i in random.Random(1).sample(range(81), 5):
        cells = [0 if k == i else v for k, v in enumerate(solved)]
        assert one(spark, selection.free_digits(F.col("c"), i), "c array<int>", (cells,)) == [solved[i]]


def test_budget(spark):
    df = spark.createDataFrame([("a", i, 4) for i in range(5)] + [("b", 0, 50)], "g string, i int, n int")
    assert sorted((r.g, r.i) for r in selection.within_budget(df, "g", ["i"], F.col("n"), 9).collect()) == [("a", 0), ("a", 1)]
