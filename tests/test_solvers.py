import random
from itertools import permutations, product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lapidary.functions import solvers as s


def test_24():
    assert s.solve_24([9, 5, 2, 2])
    assert all(abs(eval(x) - 24) < 1e-9 for x in s.solve_24([9, 5, 2, 2]))  # noqa: S307
    assert s.solve_24([3, 3, 8, 8]) and not s.solve_24([1, 1, 1, 1]) and not s.solve_24([])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=3, max_size=3))
def test_24_against_all_forms(numbers):
    def values(items):
        if len(items) == 1:
            yield items[0]
            return
        for i, j in permutations(range(len(items)), 2):
            rest = [items[k] for k in range(len(items)) if k not in (i, j)]
            a, b = items[i], items[j]
            for v in [a + b, a - b, a * b] + ([a / b] if b else []):
                yield from values([*rest, v])

    assert bool(s.solve_24(numbers)) == any(abs(v - 24) < 1e-6 for v in values(numbers))


def test_sum():
    found = s.solve_sum(["SEND", "MORE"], "MONEY")
    assert len(found) == 1
    d = found[0]
    n = lambda w: int("".join(str(d[x]) for x in w))
    assert n("SEND") + n("MORE") == n("MONEY")
    assert s.solve_sum([], "A") == [] and s.solve_sum(["ABCDEFGHIJK"], "L") == []
    assert len(s.solve_sum(["A"], "B", 3)) == 0 or all(x["A"] == x["B"] for x in s.solve_sum(["A"], "B", 3))


@pytest.mark.parametrize("text", ["(6+3)*(5-2)", "2^3", "8÷4×3", "sqrt(9)+abs(-1)", "max(1,2,3)"])
def test_evaluate(text):
    assert s.evaluate(text)[1] == ""


@pytest.mark.parametrize("text", ["1/0", "__import__('os')", "a+1", "", None, "9**9**9", "(" * 300, "x" * 5000, "1 if 1 else 2"])
def test_evaluate_errors(text):
    v, error = s.evaluate(text)
    assert v is None and error


def test_latin_and_sudoku():
    done = s.solve_latin("1 0 0,0 0 1,0 1 0")
    assert done["solved"] and done["solution"] == "1 2 3,2 3 1,3 1 2"
    assert not s.solve_latin("1 0 0,0 0 2,0 1 0")["solved"] and not s.solve_latin("")["solved"] and not s.solve_latin(None)["solved"]
    rows = [list(map(int, r.split())) for r in s.solve_sudoku("53..7....6..195....98....6.8...6...34..8.3..17...2...6.6....28....419..5....8..79")["solution"].split(",")]
    for line in [*rows, *zip(*rows)]:
        assert sorted(line) == list(range(1, 10))
    assert not s.solve_sudoku("12")["solved"]


def test_skyscraper_against_all_squares():
    rng = random.Random(5)
    for _ in range(10):
        g = s.random_latin(4, rng.randrange(1000))
        cols = list(zip(*g))
        v = s.seen_from_front
        out = s.solve_skyscraper(4, [v(c) for c in cols], [v(c[::-1]) for c in cols], [v(r) for r in g], [v(r[::-1]) for r in g])
        assert out["solved"]
        got = [list(map(int, r.split())) for r in out["solution"].split(",")]
        assert all(sorted(x) == [1, 2, 3, 4] for x in [*got, *map(list, zip(*got))])
        assert [v(c) for c in zip(*got)] == [v(c) for c in cols]
    assert not s.solve_skyscraper(8)["solved"]


def test_word_search():
    grid = ["ABCDE", "FGHIJ", "KLMNO", "PQRST", "UVWXY"]
    assert s.find_word(grid, "abc") == (1, 1, 1, 3, "E") and s.find_word(grid, "KLM") == (3, 1, 3, 3, "E")
    assert s.find_word(grid, "XYZ") is None and s.find_word(grid, "MGA") == (3, 3, 1, 1, "NW") and s.find_word([], "A") is None


def test_mines():
    out = s.solve_mines(["1X", "11"])
    assert out["board"] == "1M\n11" and out["solved"]
    assert s.solve_mines(["0X"])["board"] == "0S"
    assert s.solve_mines(["0M"])["error"] and s.solve_mines([])["solved"] is False
    assert s.solve_mines(["X1X", "2X2", "X1X"])["undetermined"] == 5


def test_stars_against_brute_force():
    regions = ["AABBB", "AABBC", "DDBCC", "DEECC", "DEEEC"]
    out = s.solve_stars(5, regions, 1)
    assert out["solved"]
    legal = []
    for p in permutations(range(5)):
        if all(abs(p[i] - p[i + 1]) > 1 for i in range(4)) and len({regions[r][c] for r, c in enumerate(p)}) == 5:
            legal.append(" ".join(f"{r + 1}:{c + 1}" for r, c in enumerate(p)))
    assert out["solution"] in legal
    assert not s.solve_stars(2, ["AA", "BB"], 1)["solved"] and not s.solve_stars(11, [], 2)["solved"]


def test_counts_and_catalog(spark):
    assert s.count_solutions("24points", "9 5 2 2")["solvable"] and s.count_solutions("x", "")["count"] == -1
    assert s.count_solutions("latin", "1 0,0 0")["count"] == 1
    names = s.register(spark)
    assert "solve_sudoku" in names
    assert spark.sql("select solve_latin('1 0,0 0').solution as s").first().s == "1 2,2 1"
    assert spark.sql("select evaluate('2*3').result as r, size(solve_24(array(9,5,2,2))) > 0 as ok").first().r == 6.0


def test_random_latin():
    for n, seed in product((1, 4, 7), (1, 2)):
        g = s.random_latin(n, seed)
        assert all(sorted(x) == list(range(1, n + 1)) for x in [*g, *map(list, zip(*g))]) and g == s.random_latin(n, seed)
