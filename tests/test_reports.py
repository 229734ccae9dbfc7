import pytest
from pyspark.sql import functions as F

from lapidary.operators import reports

TESTS = "version string, rule_id string, test string, ok boolean"


def results(spark, **of):
    rows = [(v, r, str(k), ok) for v, rules in of.items() for r, oks in rules.items() for k, ok in enumerate(oks)]
    return spark.createDataFrame(rows, TESTS)


def test_ci_gates(spark):
    good, fair, bad = [True] * 10, [True] * 9 + [False], [True] * 6 + [False] * 4
    df = results(spark, a={"1": good, "2": fair}, b={"1": good, "2": good}, c={"1": fair, "2": good}, d={"1": fair, "10": good, "2": good, "9": bad, "3": good}, e={"1": bad, "2": bad})
    got = {r.version: (r.passed, r.reason) for r in reports.ci_gates(df).collect()}
    assert got["a"] == (True, "PASS") and got["b"] == (True, "PASS")
    assert got["c"] == (False, "1 regressions detected")
    assert got["d"] == (False, "Rule 9 rate 60% < 70%") and got["e"] == (False, "Pass rate 60% < 85%")
    assert reports.ci_gates(df.limit(0)).count() == 0
    r = {x.version: x for x in reports.version_reports(df).collect()}
    assert (r["b"].regressions, r["b"].improvements, r["b"].both_fail, r["b"].parent) == (0, 1, 0, "a") and r["a"].parent is None and r["a"].regressions == 0


def test_promotion_gates(spark):
    rows = [("a", "1", i < 5, True, True) for i in range(10)] + [("a", "2", True, True, True)] * 5
    rows += [("b", "1", i < 9, True, True) for i in range(10)] + [("b", "2", True, True, True)] * 5
    rows += [("c", "1", True, i < 9, i < 9) for i in range(10)]
    df = spark.createDataFrame(rows, "version string, rule_id string, ok boolean, structural boolean, fresh boolean")
    got = {r.version: (r.promoted, r.reasons) for r in reports.promotion_gates(df).collect()}
    assert got == {"b": (True, ""), "c": (False, "structural rate fell,non-duplicate rate fell,a rule lost too much")}


def test_problems(spark):
    rows = [("a", "1", "q one", "[[1]]", 1), ("b", "1", " q one ", "x", 2), ("c", "2", "held", "[[1", 3), ("d", "1", "held", None, 4), ("e", "1", None, "[[2]]", 5)]
    df = spark.createDataFrame(rows, "idx string, rule_id string, question string, answer string, _held int").drop("_held")
    evals = spark.createDataFrame([("2", "held", "x"), ("2", None, "y"), ("2", "held", "x")], "rule_id string, question string, answer string")
    got = [(r.idx, r.position, r.problem) for r in reports.problems(df, evals, "idx").orderBy("position").collect()]
    assert got == [("b", 1, "bad_format"), ("b", 2, "DUP_INTRA"), ("c", 3, "DUP_OF_EVAL"), ("d", 4, "bad_format"), ("d", 5, "DUP_INTRA")]
    assert reports.problems(df, evals, "idx", 2).count() == 2 and reports.problems(df.limit(0), evals, "idx").count() == 0


def test_tools_and_delays(spark):
    rows = spark.createDataFrame([("solver", "15"), ("solver", None), ("reviewer", "15"), ("other", "1")], "role string, rule string")
    got = [r.t for r in rows.select(reports.role_tools(F.col("role"), F.col("rule")).alias("t")).collect()]
    assert got[0][:2] == ["solve_sudoku", "solve_latin_square"] and got[0][-1] == "format_converter" and len(got[0]) == len(set(got[0])) == len(got[1]) + 4
    assert got[2][0] == "verify_answer" and got[3] == []
    delays = spark.createDataFrame([(0, "HTTP 429"), (2, "Rate limited"), (1, "Timeout"), (0, "503"), (1, "bad key"), (1, None)], "a int, m string")
    assert [r.d for r in delays.select(reports.backoff(F.col("a"), F.col("m")).alias("d")).collect()] == [1.0, 2.25, pytest.approx(2.25), 1.5, None, None]


def test_described_sessions(spark):
    rows = [("s", str(r), i, i % 2 == 0) for i, r in enumerate([1, 1, 2, 3, 4, None])] + [(None, "1", 9, True), ("t", "1", 10, None)]
    got = {r.session_id: r.description for r in reports.described_sessions(spark.createDataFrame(rows, "session_id string, rule_id string, id long, passed boolean")).collect()}
    assert got == {"s": "Rule 3: 0/1 passed\nRule 4: 1/1 passed\nRule None: 0/1 passed", "t": "Rule 1: 0/1 passed"}
