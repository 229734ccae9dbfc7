"""Grids in answers, as arrays of rows of cells, and the checks on them.

``grid_of`` reads an unwrapped body: rows between commas, cells between blanks, blank rows dropped. All functions are
Spark expressions; a null answer gives null (checks: false).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapidary.functions import fixed
from lapidary.functions.text import WS, _col, is_wrapped, let, strip, unwrap

_DIGITS = r"^-*[0-9]+$"


def grid_of(body: Column) -> Column:
    rows = F.filter(F.split(body, ","), lambda r: strip(r) != "")
    return F.transform(rows, lambda r: F.split(strip(r), f"{WS}+"))


def grid(answer: Column | str) -> Column:
    return grid_of(unwrap(answer))


def spanned_grid(answer: Column | str) -> Column:
    """The grid of the first ``[[...]]`` span; empty without one."""
    inner = F.regexp_extract(_col(answer), r"(?s)\[\[(.*?)\]\]", 1)
    return F.when(inner == "", F.array().cast("array<array<string>>")).otherwise(grid_of(inner))


def shape(g: Column) -> Column:
    """(rows, columns of the first row)."""
    return F.struct(F.size(g).alias("rows"), F.when(F.size(g) > 0, F.size(g[0])).otherwise(0).alias("columns"))


def all_digits(g: Column, inner_dashes: bool = False) -> Column:
    """Whether all cells are digits with dashes before them, or anywhere with ``inner_dashes``."""
    pattern = r"^-*[0-9][-0-9]*$" if inner_dashes else _DIGITS
    return F.forall(F.flatten(g), lambda c: c.rlike(pattern))


def rectangular(g: Column) -> Column:
    return (F.size(g) > 0) & (F.size(F.array_distinct(F.transform(g, F.size))) == 1)


def integer_grid(text: Column | str) -> Column:
    """Cells as integers: rows between commas or line breaks; a row of one longer token is spelt out; blanks, marks and junk are 0."""
    rows = F.filter(F.split(F.regexp_replace(_col(text), "\n", ","), ","), lambda r: strip(r) != "")

    def cells(r):
        parts = F.split(strip(r), f"{WS}+")
        alone = (F.size(parts) == 1) & (F.length(parts[0]) > 1)
        return F.when(alone, F.filter(F.split(parts[0], ""), lambda c: c != "")).otherwise(parts)

    return F.transform(rows, lambda r: F.transform(cells(r), lambda c: F.when(c.rlike("^-?[0-9]{1,9}$"), c.cast("int")).otherwise(0)))


def sudoku_cells(text: Column | str) -> Column:
    """81 integers of a sudoku in one string, separators left out; null if there are fewer. Marks and junk are 0."""
    plain = F.regexp_replace(_col(text), r"[\n, |]", "")
    cells = F.transform(F.sequence(F.lit(1), F.lit(81)), lambda i: F.substring(plain, i, F.lit(1)))
    return F.when(F.length(plain) >= 81, F.transform(cells, lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(0)))


def rendered(g: Column) -> Column:
    """Cells joined by blanks, rows by commas."""
    return F.array_join(F.transform(g, lambda r: F.array_join(r, " ")), ",")


def wrapped(body: Column) -> Column:
    return F.concat(F.lit("[["), body, F.lit("]]"))


def transposed(g: Column) -> Column:
    """Columns of a grid whose rows are as long as the first one."""
    return F.transform(F.sequence(F.lit(0), F.size(g[0]) - 1), lambda j: F.transform(g, lambda r: F.get(r, j)))


def symmetries(g: Column) -> Column:
    """The eight rotations and reflections of a square grid, rendered."""
    upside = F.reverse(g)
    across = F.transform(g, F.reverse)
    both = F.transform(F.reverse(g), F.reverse)
    forms = [g, upside, across, both, transposed(g), transposed(upside), transposed(across), transposed(both)]
    return F.array(*[rendered(x) for x in forms])


def canonical(g: Column) -> Column:
    """The least rendering among the eight symmetries; of a grid that isn't square, its own rendering."""

    def least(x):
        square = rectangular(x) & (F.size(x) == F.size(F.get(x, F.lit(0))))
        return F.when(square, F.array_min(symmetries(x))).otherwise(rendered(x))

    return let(g, least)


def visible(row: Column) -> Column:
    """How many members of an integer array are larger than all before them."""
    start = F.struct(F.lit(0).alias("most"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["most"], x).alias("most"), (a["n"] + F.when(x > a["most"], 1).otherwise(0)).alias("n"))
    return F.aggregate(row, start, step, lambda a: a["n"])


def _complete(line: Column, n: Column) -> Column:
    return F.sort_array(F.array_distinct(line)) == F.sequence(F.lit(1), n)


def full_check(answer: Column | str, kind: str) -> Column:
    """Errors of a grid: ``latin`` and ``skyscraper`` need all of 1..n in every row and column, ``sudoku`` also in the boxes
    of a 9 by 9 grid, ``generic`` rows of one length."""
    return let(grid(answer), lambda g: let(_numbers(g), lambda numbers: _full_check(g, numbers, kind)))


def _numbers(g: Column) -> Column:
    return F.transform(g, lambda r: F.transform(r, lambda c: F.try_to_number(c, F.lit("S999999999")).cast("int")))


def _full_check(g: Column, numbers: Column, kind: str) -> Column:
    none = F.array().cast("array<string>")

    def lines(name, parts, n):
        bad = F.filter(F.transform(parts, lambda x, i: F.when(_complete(x, n), F.lit(None).cast("string")).otherwise(F.concat(F.lit(name + " "), (i + 1).cast("string")))), lambda x: x.isNotNull())
        return bad

    n = F.size(g)
    if kind == "generic":
        errors = F.when(rectangular(g), none).otherwise(F.array(F.lit("uneven rows")))
    elif kind in ("latin", "skyscraper"):
        square = F.forall(g, lambda r: F.size(r) == n)
        both = F.concat(lines("row", numbers, n), lines("column", transposed(numbers), n))
        errors = F.when(~all_digits(g), F.array(F.lit("not numeric"))).when(~square, F.array(F.lit("not square"))).otherwise(both)
    elif kind == "sudoku":
        nine = (n == 9) & F.forall(g, lambda r: F.size(r) == 9)
        boxes = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda b: F.flatten(F.transform(F.slice(numbers, F.floor(b / 3).cast("int") * 3 + 1, 3), lambda r: F.slice(r, (b % 3) * 3 + 1, 3))))
        all_lines = F.concat(lines("row", numbers, F.lit(9)), lines("column", transposed(numbers), F.lit(9)), lines("box", boxes, F.lit(9)))
        errors = F.when(~nine, F.array(F.lit("not 9 by 9"))).when(~all_digits(g), F.array(F.lit("not numeric"))).otherwise(all_lines)
    else:
        raise ValueError(f"unknown kind of grid: {kind}")
    return F.when(n == 0, F.array(F.lit("no rows"))).otherwise(errors)


def neighbours(row: Column, column: Column, rows: Column, columns: Column, diagonal: bool = False) -> Column:
    """Cells next to a cell within bounds, as an array of (r, c)."""
    steps = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r or c) and (diagonal or not (r and c))]
    cells = F.array(*[F.struct((row + r).alias("r"), (column + c).alias("c")) for r, c in steps])
    return F.filter(cells, lambda x: (x["r"] >= 0) & (x["r"] < rows) & (x["c"] >= 0) & (x["c"] < columns))


# The checks by rule. Each gives an error text, or null if the answer passes.


def format_error(answer: Column | str) -> Column:
    return F.when(~is_wrapped(answer), "Missing [[ wrapper")


def latin_error(answer: Column | str) -> Column:
    """As many cells in each row as there are rows, and if all are digits no repeated value within a row. Columns aren't looked at."""
    return let(grid(answer), _latin_error)


def _latin_error(g: Column) -> Column:
    n = F.size(g)
    uneven = F.filter(F.transform(g, lambda r, i: F.when(F.size(r) != n, i + 1)), lambda i: i.isNotNull())
    repeated = F.filter(F.transform(g, lambda r, i: F.when(F.size(F.array_distinct(F.transform(r, lambda c: F.regexp_replace(c, "^(-?)0+(?=[0-9])", "$1")))) < F.size(r), i + 1)), lambda i: i.isNotNull())
    return (
        F.when(n == 0, "Cannot parse grid")
        .when(F.size(uneven) > 0, F.concat(F.lit("Row "), uneven[0].cast("string"), F.lit(" has another length")))
        .when(all_digits(g, True) & (F.size(repeated) > 0), F.concat(F.lit("Row "), repeated[0].cast("string"), F.lit(" has duplicates")))
    )


def grid_error(answer: Column | str) -> Column:
    return let(grid(answer), lambda g: F.when(F.size(g) < 2, "Grid too small").when(~rectangular(g), "Uneven rows"))


def words_error(answer: Column | str) -> Column:
    return F.when(strip(unwrap(answer)) == "", "Empty answer")


def mapping_error(answer: Column | str) -> Column:
    """Pairs letter=digit; the last of repeated letters counts. No two letters may have the same digit."""
    return let(F.filter(F.split(unwrap(answer), ","), lambda p: F.contains(p, F.lit("="))), _mapping_error)


def _mapping_error(pairs: Column) -> Column:
    split = F.transform(pairs, lambda p: F.struct(strip(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), strip(F.regexp_replace(p, r"^[^=]*=", "")).alias("v")))
    last = F.filter(split, lambda x, i: ~F.exists(F.slice(split, i + 2, F.greatest(F.size(split) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"]))
    digits = F.transform(F.filter(last, lambda x: x["v"].rlike("^[0-9]+$")), lambda x: F.regexp_replace(x["v"], "^0+(?=[0-9])", ""))
    return F.when(F.size(pairs) == 0, "Cannot parse mapping").when(F.size(F.array_distinct(digits)) < F.size(digits), "Duplicate digits in mapping")


def answer_error(rule: Column | str, answer: Column | str, expression_error: Column | None = None) -> Column:
    """The error of an answer by its rule, or null. Expressions need a Python function; without ``expression_error`` they
    are checked for the wrapper only. A null answer misses the wrapper."""
    r = _col(rule)
    expression = format_error(answer) if expression_error is None else expression_error
    by_rule = (
        F.when(r.isin(fixed.LATIN_RULES), latin_error(answer))
        .when(r.isin(fixed.GRID_RULES), grid_error(answer))
        .when(r.isin(fixed.WORD_RULES), words_error(answer))
        .when(r.isin(fixed.MAPPING_RULES), mapping_error(answer))
        .when(r.isin(fixed.EXPRESSION_RULES), expression)
        .otherwise(format_error(answer))
    )
    return F.when(_col(answer).isNull(), "Missing [[ wrapper").otherwise(by_rule)


def output_errors(question: Column | str, answer: Column | str) -> Column:
    """Errors of a generated pair: the question below 20 characters, no wrapper, the answer below 6 characters. Nulls count as empty."""
    q, a = F.coalesce(_col(question), F.lit("")), F.coalesce(_col(answer), F.lit(""))
    return F.array_compact(F.array(F.when(F.length(q) < 20, "question too short"), F.when(~is_wrapped(a), "no wrapper"), F.when(F.length(a) < 6, "answer too short")))
