"""Searches over small puzzles, as plain Python functions and as Spark table functions over batches of rows.

Spark has no backtracking, so these run in Python workers, one call per row in Arrow batches. Each search has a limit
of steps; a search that reaches it is reported as not solved. Errors are values, never exceptions.
"""

from __future__ import annotations

import ast
import operator
import random
import re
from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, MapType, StringType, StructField, StructType

#: Limits of steps.
SUDOKU_STEPS, LATIN_STEPS, SKYSCRAPER_STEPS, STAR_STEPS = 100_000, 50_000, 100_000, 200_000

_OPERATORS = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv,
    ast.Mod: operator.mod, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos,
}
_FUNCTIONS = {"abs": abs, "round": round, "min": min, "max": max, "sum": lambda *x: sum(x), "pow": pow, "int": int, "float": float, "sqrt": lambda x: x**0.5}


def _value(node: ast.AST):
    if isinstance(node, ast.Expression):
        return _value(node.body)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return node.value
    if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
        a, b = _value(node.left), _value(node.right)
        if isinstance(node.op, ast.Pow) and (abs(b) > 64 or abs(a) > 1e6):
            raise ValueError("power too large")
        return _OPERATORS[type(node.op)](a, b)
    if isinstance(node, ast.UnaryOp) and type(node.op) in _OPERATORS:
        return _OPERATORS[type(node.op)](_value(node.operand))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS and not node.keywords:
        return _FUNCTIONS[node.func.id](*[_value(a) for a in node.args])
    raise ValueError("not an arithmetic expression")


def evaluate(text: str | None) -> tuple[float | None, str]:
    """(value, error) of an arithmetic expression; × ÷ ^ stand for * / **. Never runs code."""
    if text is None or len(text) > 2000:
        return None, "no expression"
    try:
        v = _value(ast.parse(text.replace("×", "*").replace("÷", "/").replace("^", "**").strip(), mode="eval"))
        return float(v), ""
    except ZeroDivisionError:
        return None, "division by zero"
    except (ValueError, SyntaxError, TypeError, OverflowError, RecursionError, MemoryError):
        return None, "not an arithmetic expression"


def solve_24(numbers: list[int], target: int = 24) -> list[str]:
    """Expressions over all the numbers, each once, that give the target exactly; one for each way of building up values."""
    found: set[str] = set()

    def reduce(items: tuple[tuple[Fraction, str], ...]) -> None:
        if len(items) == 1:
            if items[0][0] == target:
                found.add(items[0][1].removeprefix("(").removesuffix(")") if items[0][1].startswith("(") else items[0][1])
            return
        seen = set()
        for i, (a, x) in enumerate(items):
            for j, (b, y) in enumerate(items):
                if i == j:
                    continue
                rest = tuple(items[k] for k in range(len(items)) if k not in (i, j))
                made = [(a - b, f"({x}-{y})")]
                if i < j:
                    made += [(a + b, f"({x}+{y})"), (a * b, f"({x}*{y})")]
                if b:
                    made.append((a / b, f"({x}/{y})"))
                for item in made:
                    key = tuple(sorted([v for v, _ in rest] + [item[0]]))
                    if key not in seen:
                        seen.add(key)
                        reduce((*rest, item))

    if numbers:
        reduce(tuple((Fraction(n), str(n)) for n in numbers))
    return sorted(found)


def solve_sum(addends: list[str], result: str, cap: int = 5) -> list[dict[str, int]]:
    """At most ``cap`` assignments of distinct digits to letters for which the addends sum to the result, no leading zeros.

    Letters are tried in the order of their columns from the right; a column is checked as soon as its letters have digits.
    """
    words = [*addends, result]
    if not addends or not all(words):
        return []
    width = max(map(len, words))
    weight: dict[str, int] = {}
    order: list[str] = []
    ready: list[int] = []
    for i in range(width):
        for w in words:
            if i < len(w) and w[-1 - i] not in order:
                order.append(w[-1 - i])
        ready.append(len(order))
    for w in addends:
        for i, x in enumerate(reversed(w)):
            weight[x] = weight.get(x, 0) + 10**i
    for i, x in enumerate(reversed(result)):
        weight[x] = weight.get(x, 0) - 10**i
    if len(order) > 10:
        return []
    leading = {w[0] for w in words if len(w) > 1}
    digit: dict[str, int] = {}
    out: list[dict[str, int]] = []

    def column_holds(i: int) -> bool:
        total = 0
        for w in addends:
            for k in range(min(i + 1, len(w))):
                total += digit[w[-1 - k]] * 10**k
        for k in range(min(i + 1, len(result))):
            total -= digit[result[-1 - k]] * 10**k
        return total % 10 ** (i + 1) == 0

    def assign(k: int) -> None:
        if len(out) >= cap:
            return
        if k and k in ready and not all(column_holds(i) for i in range(width) if ready[i] == k):
            return
        if k == len(order):
            if sum(weight[x] * d for x, d in digit.items()) == 0:
                out.append(dict(digit))
            return
        for d in range(10):
            if d not in digit.values() and (d or order[k] not in leading):
                digit[order[k]] = d
                assign(k + 1)
                del digit[order[k]]

    assign(0)
    return out


def _fill(cells: list[int], groups: list[list[int]], values: range, limit: int) -> tuple[list[int] | None, int]:
    """Fill the zeros so that no group repeats a value, first free cell first, smallest value first."""
    of = [set() for _ in cells]
    for g in groups:
        for c in g:
            of[c] |= set(g) - {c}
    free = [i for i, v in enumerate(cells) if not v]
    cells, steps, k = list(cells), 0, 0
    last = [0] * len(free)
    while 0 <= k < len(free):
        steps += 1
        if steps > limit:
            return None, steps
        c = free[k]
        used = {cells[o] for o in of[c]}
        cells[c] = 0
        for v in values:
            if v > last[k] and v not in used:
                cells[c] = last[k] = v
                k += 1
                if k < len(free):
                    last[k] = 0
                break
        else:
            last[k] = 0
            k -= 1
    return (cells if k >= 0 else None), steps


def _rows(cells: list[int], n: int) -> str:
    return ",".join(" ".join(map(str, cells[r * n : r * n + n])) for r in range(n))


_BLANKS = "0.Xx?_-"


def parse_sudoku(text: str) -> list[int] | None:
    """81 cells in one string without separators, else nine rows; marks and junk are 0."""
    plain = re.sub(r"[\n, |]", "", text)
    if len(plain) < 81:
        rows = [r.strip() for r in text.replace("\n", ",").split(",") if r.strip()]
        cells = [r.split() if len(r.split()) == 9 else list(r) for r in rows]
        if len(rows) != 9 or any(len(c) != 9 for c in cells):
            return None
        plain = "".join(x if len(x) == 1 else "0" for c in cells for x in c)
    return [int(c) if c.isdecimal() else 0 for c in plain[:81]]


def solve_sudoku(text: str | None) -> dict:
    """Rows of a filled sudoku. Given cells aren't checked against each other."""
    cells = parse_sudoku(text or "")
    if cells is None:
        return {"solution": "", "solved": False, "steps": 0, "error": "no grid"}
    lines = [[9 * r + c for c in range(9)] for r in range(9)] + [[9 * r + c for r in range(9)] for c in range(9)]
    boxes = [[9 * (3 * a + r) + 3 * b + c for r in range(3) for c in range(3)] for a in range(3) for b in range(3)]
    done, steps = _fill(cells, lines + boxes, range(1, 10), SUDOKU_STEPS)
    return {"solution": _rows(done, 9) if done else "", "solved": bool(done), "steps": steps, "error": "" if done else "not solved"}


def parse_cells(text: str) -> list[list[int]]:
    out = []
    for row in text.replace("\n", ",").split(","):
        cells = row.split()
        if len(cells) == 1 and len(cells[0]) > 1:
            cells = list(cells[0])
        if cells:
            out.append([int(c) if re.fullmatch("-*[0-9]+", c) and c.count("-") < 2 else 0 for c in cells])
    return out


def solve_latin(text: str | None, n: int = 0) -> dict:
    """Rows of a completed Latin square; the size is that of the widest row unless given."""
    rows = parse_cells(text or "")
    if not rows:
        return {"solution": "", "solved": False, "steps": 0, "error": "no grid"}
    n = n or max(map(len, rows))
    cells = [(rows[r][c] if r < len(rows) and c < len(rows[r]) else 0) for r in range(n) for c in range(n)]
    lines = [[n * r + c for c in range(n)] for r in range(n)] + [[n * r + c for r in range(n)] for c in range(n)]
    done, steps = _fill(cells, lines, range(1, n + 1), LATIN_STEPS)
    return {"solution": _rows(done, n) if done else "", "solved": bool(done), "steps": steps, "error": "" if done else "not solved"}


def seen_from_front(line) -> int:
    """How many are larger than all before them."""
    n = most = 0
    for x in line:
        if x > most:
            n, most = n + 1, x
    return n


def solve_skyscraper(n: int, top=None, bottom=None, left=None, right=None) -> dict:
    """Rows of a Latin square with the given numbers of visible heights; 0 is no clue. At most 7 by 7."""
    if not 0 < n <= 7:
        return {"solution": "", "solved": False, "steps": 0, "error": "size must be 1 to 7"}
    clue = lambda x: list(x or []) + [0] * (n - len(x or []))
    top, bottom, left, right = map(clue, (top, bottom, left, right))
    fits = []
    for r in range(n):
        fits.append([p for p in permutations(range(1, n + 1)) if left[r] in (0, seen_from_front(p)) and right[r] in (0, seen_from_front(p[::-1]))])
    chosen: list[tuple[int, ...]] = []
    steps = 0

    def place(r: int) -> bool:
        nonlocal steps
        steps += 1
        if steps > SKYSCRAPER_STEPS:
            return False
        if r == n:
            columns = list(zip(*chosen))
            return all(top[c] in (0, seen_from_front(x)) and bottom[c] in (0, seen_from_front(x[::-1])) for c, x in enumerate(columns))
        for p in fits[r]:
            if all(p[c] != row[c] for row in chosen for c in range(n)):
                chosen.append(p)
                if place(r + 1):
                    return True
                chosen.pop()
        return False

    good = place(0)
    return {"solution": ",".join(" ".join(map(str, r)) for r in chosen) if good else "", "solved": good, "steps": steps, "error": "" if good else "not solved"}


#: Directions in the order in which they are tried.
DIRECTIONS = [("NW", -1, -1), ("N", -1, 0), ("NE", -1, 1), ("W", 0, -1), ("E", 0, 1), ("SW", 1, -1), ("S", 1, 0), ("SE", 1, 1)]


def find_word(grid: list[str], word: str) -> tuple[int, int, int, int, str] | None:
    """(row, column, end row, end column, direction), from 1, of the first place of a word; places row by row, then DIRECTIONS."""
    w, rows = word.upper(), [g.upper() for g in grid]
    if not w or not rows:
        return None
    for r in range(len(rows)):
        for c in range(len(rows[r])):
            for name, dr, dc in DIRECTIONS:
                cells = [(r + dr * k, c + dc * k) for k in range(len(w))]
                if all(0 <= y < len(rows) and 0 <= x < len(rows[y]) and rows[y][x] == ch for (y, x), ch in zip(cells, w)):
                    return r + 1, c + 1, cells[-1][0] + 1, cells[-1][1] + 1, name
    return None


def solve_mines(grid: list[str]) -> dict:
    """Mines (M) and safe cells (S) that follow from single clues, applied until nothing changes; unknown cells are X x ? or a point."""
    board = [list(r) for r in grid]
    size = [len(r) for r in board]

    def around(r: int, c: int):
        return [(y, x) for y in (r - 1, r, r + 1) for x in (c - 1, c, c + 1) if (y, x) != (r, c) and 0 <= y < len(board) and 0 <= x < size[y]]

    error, changed = "", True
    while changed and not error:
        changed = False
        for r in range(len(board)):
            for c in range(size[r]):
                if not board[r][c].isdecimal():
                    continue
                near = around(r, c)
                unknown = [p for p in near if board[p[0]][p[1]] in "Xx?."]
                left = int(board[r][c]) - sum(board[y][x] in "Mm*" for y, x in near)
                if left < 0:
                    error = f"contradiction at row {r + 1}, column {c + 1}"
                elif unknown and left in (0, len(unknown)):
                    for y, x in unknown:
                        board[y][x] = "M" if left else "S"
                    changed = True
    open_cells = sum(x in "Xx?." for row in board for x in row)
    return {"board": "\n".join("".join(r) for r in board), "undetermined": open_cells, "solved": not error and not open_cells and bool(board), "error": error}


def solve_stars(n: int, regions: list[str], stars: int = 2) -> dict:
    """Cells (from 1) of stars, so many in each row, column and region and none touching; cells are first tried without a star."""
    if not 0 < n <= 10:
        return {"solution": "", "solved": False, "steps": 0, "error": "size must be 1 to 10"}
    label = lambda r, c: regions[r][c] if r < len(regions) and c < len(regions[r]) else "?"
    names = sorted({label(r, c) for r in range(n) for c in range(n)})
    # How many cells of a line are still to come, to leave branches that can't be completed.
    region_after: list[dict[str, int]] = [{} for _ in range(n * n + 1)]
    for k in range(n * n - 1, -1, -1):
        region_after[k] = dict(region_after[k + 1])
        name = label(*divmod(k, n))
        region_after[k][name] = region_after[k].get(name, 0) + 1
    rows, columns, by_region = [0] * n, [0] * n, dict.fromkeys(names, 0)
    placed: set[tuple[int, int]] = set()
    steps = 0

    def place(k: int) -> bool:
        nonlocal steps
        steps += 1
        if steps > STAR_STEPS:
            return False
        r, c = divmod(k, n)
        if k and not c and rows[r - 1] != stars:
            return False
        if k == n * n:
            return all(x == stars for x in columns) and all(x == stars for x in by_region.values())
        if any(by_region[x] + region_after[k].get(x, 0) < stars for x in names):
            return False
        if place(k + 1):
            return True
        name = label(r, c)
        touching = any((y, x) in placed for y in (r - 1, r, r + 1) for x in (c - 1, c, c + 1))
        if touching or rows[r] >= stars or columns[c] >= stars or by_region[name] >= stars:
            return False
        placed.add((r, c))
        rows[r], columns[c], by_region[name] = rows[r] + 1, columns[c] + 1, by_region[name] + 1
        if place(k + 1):
            return True
        placed.discard((r, c))
        rows[r], columns[c], by_region[name] = rows[r] - 1, columns[c] - 1, by_region[name] - 1
        return False

    good = place(0)
    cells = " ".join(f"{r + 1}:{c + 1}" for r, c in sorted(placed)) if good else ""
    return {"solution": cells, "solved": good, "steps": steps, "error": "" if good else "not solved"}


def random_latin(n: int, seed: int) -> list[list[int]]:
    """A Latin square of 1..n: rows, columns and values of the cyclic square shuffled by the seed."""
    rng = random.Random(seed)
    rows, columns, values = (rng.sample(range(n), n) for _ in range(3))
    return [[values[(r + c) % n] + 1 for c in columns] for r in rows]


def count_solutions(kind: str, data: str | None) -> dict:
    """(count, solvable) by kind of puzzle; for sudoku and Latin squares one solution counts, without proof that there is no other."""
    if kind == "24points":
        numbers = [int(x) for x in re.findall(r"\d+", data or "")][:4]
        n = len(solve_24(numbers)) if len(numbers) == 4 else 0
        return {"count": n, "solvable": n > 0}
    if kind in ("sudoku", "latin"):
        n = int((solve_sudoku if kind == "sudoku" else solve_latin)(data)["solved"])
        return {"count": n, "solvable": n > 0}
    return {"count": -1, "solvable": False}


_SOLUTION = StructType([StructField("solution", StringType()), StructField("solved", BooleanType()), StructField("steps", IntegerType()), StructField("error", StringType())])


def _frame(results: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(results, columns=["solution", "solved", "steps", "error"])


@F.pandas_udf(_SOLUTION)
def sudoku_udf(text: pd.Series) -> pd.DataFrame:
    return _frame([solve_sudoku(x) for x in text])


@F.pandas_udf(_SOLUTION)
def latin_udf(text: pd.Series) -> pd.DataFrame:
    return _frame([solve_latin(x) for x in text])


@F.pandas_udf(_SOLUTION)
def skyscraper_udf(n: pd.Series, top: pd.Series, bottom: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
    rows = lambda x: None if x is None else [int(v) for v in x]
    return _frame([solve_skyscraper(int(a), rows(b), rows(c), rows(d), rows(e)) for a, b, c, d, e in zip(n, top, bottom, left, right)])


@F.pandas_udf(_SOLUTION)
def stars_udf(n: pd.Series, regions: pd.Series, stars: pd.Series) -> pd.DataFrame:
    return _frame([solve_stars(int(a), list(b), int(c)) for a, b, c in zip(n, regions, stars)])


@F.pandas_udf(ArrayType(StringType()))
def solve_24_udf(numbers: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else solve_24([int(v) for v in x]) for x in numbers])


@F.pandas_udf(ArrayType(MapType(StringType(), IntegerType())))
def solve_sum_udf(addends: pd.Series, result: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or r is None else [list(s.items()) for s in solve_sum(list(a), r)] for a, r in zip(addends, result)])


_BOARD = StructType([StructField("board", StringType()), StructField("undetermined", IntegerType()), StructField("solved", BooleanType()), StructField("error", StringType())])


@F.pandas_udf(_BOARD)
def mines_udf(grid: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([solve_mines([] if g is None else list(g)) for g in grid], columns=["board", "undetermined", "solved", "error"])


@F.pandas_udf(StructType([StructField("result", DoubleType()), StructField("error", StringType())]))
def evaluate_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([evaluate(x) for x in text], columns=["result", "error"])


def expression_error(answer):
    """The error of an answer that should evaluate to 24, or null."""
    from lapidary.functions.text import unwrap

    v = evaluate_udf(unwrap(answer))
    return F.when(v["error"] != "", "Cannot evaluate expression").when(F.abs(v["result"] - 24) > 1e-9, "Does not evaluate to 24")


#: The functions of the catalog by name, with what they take and give; register() makes them known to SQL.
CATALOG = {
    "solve_sudoku": (sudoku_udf, "text -> solution, solved, steps, error"),
    "solve_latin": (latin_udf, "text -> solution, solved, steps, error"),
    "solve_skyscraper": (skyscraper_udf, "n, top, bottom, left, right -> solution, solved, steps, error"),
    "solve_stars": (stars_udf, "n, regions, stars -> solution, solved, steps, error"),
    "solve_24": (solve_24_udf, "numbers -> expressions"),
    "solve_sum": (solve_sum_udf, "addends, result -> assignments"),
    "solve_mines": (mines_udf, "rows -> board, undetermined, solved, error"),
    "evaluate": (evaluate_udf, "expression -> result, error"),
}


def register(spark) -> list[str]:
    """Make the catalog known to SQL; the names."""
    for name, (f, _) in CATALOG.items():
        spark.udf.register(name, f)
    return list(CATALOG)
