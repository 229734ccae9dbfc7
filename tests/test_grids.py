import random

import pytest
from pyspark.sql import functions as F

from lapidary.functions import grids, solvers


def of(spark, column, *rows, name="a"):
    return [r.v for r in spark.createDataFrame([(x,) for x in rows], f"{name} string").select(column.alias("v")).collect()]


def test_grid(spark):
    assert of(spark, grids.grid("a"), "[[a b, c d,,]]", "", "[[ ]]", None) == [[["a", "b"], ["c", "d"]], [], [], None]


@pytest.mark.parametrize(
    ("rule", "answer", "error"),
    [
        ("15", "[[1 2,2 1]]", None), ("15", "[[1 1,2 2]]", "Row 1 has duplicates"), ("15", "[[1 2 3,1 2]]", "Row 1 has another length"), ("15", "[[]]", "Cannot parse grid"),
        ("15", "[[a a,b b]]", None), ("11", "[[1 2]]", "Grid too small"), ("11", "[[1 2,3]]", "Uneven rows"), ("11", "[[1 2,3 4]]", None),
        ("2", "[[ ]]", "Empty answer"), ("2", "word", None), ("5", "[[A=1, B=2]]", None), ("5", "[[A=1, B=1]]", "Duplicate digits in mapping"), ("5", "[[A=1, A=2, B=1]]", None),
        ("5", "x", "Cannot parse mapping"), ("1", "x", "Missing [[ wrapper"), ("99", " [[x]]", None), ("15", None, "Missing [[ wrapper"), ("15", "[[01 1,1 2]]", "Row 1 has duplicates"),
    ],
)
def test_answer_error(spark, rule, answer, error):
    df = spark.createDataFrame([(rule, answer)], "r string, a string")
    assert df.select(grids.answer_error("r", "a").alias("e")).first().e == error


def test_full_check(spark):
    assert of(spark, grids.full_check("a", "latin"), "[[1 2,2 1]]", "[[1 2,1 2]]", "[[a b,b a]]", "[[1 2,2]]", "") == [[], ["column 1", "column 2"], ["not numeric"], ["not square"], ["no rows"]]
    solved = solvers.solve_sudoku("53..7....6..195....98....6.8...6...34..8.3..17...2...6.6....28....419..5....8..79")["solution"]
    wrong = solved.replace("5 3 4", "3 5 4", 1)
    good, bad = of(spark, grids.full_check("a", "sudoku"), solved, wrong)
    assert good == [] and {x.split()[0] for x in bad} == {"column"}
    assert of(spark, grids.full_check("a", "generic"), "[[1 2,3 4]]", "[[1,2 3]]") == [[], ["uneven rows"]]


def test_canonical_is_invariant(spark):
    g = [["a", "b", "c"], ["d", "e", "f"], ["g", "h", "i"]]
    forms = []
    for flip in (False, True):
        x = [r[::-1] for r in g] if flip else g
        for _ in range(4):
            forms.append("[[" + ",".join(" ".join(r) for r in x) + "]]")
            x = [list(r) for r in zip(*x[::-1])]
    assert len(set(forms)) == 8
    assert set(of(spark, grids.canonical(grids.grid("a")), *forms)) == {"a b c,d e f,g h i"}
    assert of(spark, grids.canonical(grids.grid("a")), "[[a b]]") == ["a b"]


@pytest.mark.parametrize(("row", "n"), [([1, 2, 3, 4], 4), ([4, 3, 2, 1], 1), ([2, 1, 4, 3], 2), ([], 0)])
def test_visible(spark, row, n):
    df = spark.createDataFrame([(row,)], "r array<int>")
    assert df.select(grids.visible(F.col("r")).alias("v")).first().v == n == solvers.seen_from_front(row)


def test_parsing_variants(spark):
    assert of(spark, grids.integer_grid("a"), "1X3\n. 5 ?,7") == [[[1, 0, 3], [0, 5, 0], [7]]]
    assert of(spark, F.size(grids.sudoku_cells("a")), "1" * 81) == [81]
    assert of(spark, grids.sudoku_cells("a"), "12") == [None]
    n = spark.range(1).select(grids.neighbours(F.lit(0), F.lit(0), F.lit(2), F.lit(2), True).alias("n")).first().n
    assert {(x.r, x.c) for x in n} == {(0, 1), (1, 0), (1, 1)}
