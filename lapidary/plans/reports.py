"""Queries of reports, gates, probes and solvers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.functions import fixed, intents, solvers
from lapidary.operators import curation, reports
from lapidary.plans.catalog import L, T, _evals, _finals, _log, _traces, query, s_list, s_strip, s_wrapped

_OK = "len(coalesce(errors, [])) = 0"
_TESTS = f"""WITH {T}, g AS (SELECT model AS version, rule_id, stage AS test, bool_and({_OK}) AS ok FROM t WHERE rule_id IS NOT NULL GROUP BY ALL),
    w AS (SELECT version, lag(version) OVER (ORDER BY version) AS parent FROM (SELECT DISTINCT version FROM g)),
    x AS (SELECT g.*, w.parent, b.ok AS before FROM g JOIN w USING (version) LEFT JOIN g b ON b.version = w.parent AND b.rule_id = g.rule_id AND b.test = g.test),
    r AS (SELECT version, parent, count(*) AS total, count_if(ok) AS passed, count(*) FILTER (WHERE before AND NOT ok) AS regressions, count(*) FILTER (WHERE NOT before AND ok) AS improvements, count(*) FILTER (WHERE NOT before AND NOT ok) AS both_fail FROM x GROUP BY ALL),
    u AS (SELECT version, rule_id, count(*) AS total, count_if(ok) AS passed, count_if(ok) / count(*) AS rate FROM g GROUP BY ALL)"""


def _ok():
    return F.size(F.coalesce("errors", F.array().cast("array<string>"))) == 0


def _tests(spark: SparkSession, base: str) -> DataFrame:
    rows = _traces(spark, base).where("rule_id is not null")
    return rows.groupBy(F.col("model").alias("version"), "rule_id", F.col("stage").alias("test")).agg(F.every(_ok()).alias("ok"))


@query(f"{_TESTS} SELECT version, parent, total, passed, regressions, improvements, both_fail, round(passed / total, 6) AS pass_rate FROM r")
def version_reports(spark: SparkSession, base: str) -> DataFrame:
    return reports.version_reports(_tests(spark, base)).withColumn("pass_rate", F.round("pass_rate", 6))


@query(f"{_TESTS} SELECT version, rule_id, total, passed, round(rate, 6) AS rate FROM u")
def version_rule_rates(spark: SparkSession, base: str) -> DataFrame:
    return reports.rule_rates(_tests(spark, base)).withColumn("rate", F.round("rate", 6))


@query(
    f"""{_TESTS}, low AS (SELECT version, min_by(rule_id, rule_id::INT) AS rule_id, min_by(rate, rule_id::INT) AS rate FROM u WHERE rate < 0.7 GROUP BY version),
    o AS (SELECT r.version, CASE WHEN passed / total < 0.85 THEN 'Pass rate ' || round_even(passed / total * 100, 0)::INT || '% < 85%' WHEN regressions > 0 THEN regressions || ' regressions detected'
        WHEN low.rule_id IS NOT NULL THEN 'Rule ' || low.rule_id || ' rate ' || round_even(low.rate * 100, 0)::INT || '% < 70%' ELSE 'PASS' END AS reason FROM r LEFT JOIN low USING (version))
    SELECT version, reason = 'PASS' AS passed, reason FROM o"""
)
def ci_gates(spark: SparkSession, base: str) -> DataFrame:
    return reports.ci_gates(_tests(spark, base))


@query(
    f"""WITH {T}, c AS (SELECT model AS version, rule_id, {_OK} AS ok, error_category <> 'structure' AS structural, error_category <> 'duplicate' AS fresh FROM t WHERE rule_id IS NOT NULL AND model IS NOT NULL),
    w AS (SELECT version, lag(version) OVER (ORDER BY version) AS parent FROM (SELECT DISTINCT version FROM c)),
    v AS (SELECT version, avg(ok::INT) AS ok, avg(structural::INT) AS structural, avg(fresh::INT) AS fresh FROM c GROUP BY version),
    u AS (SELECT version, rule_id, avg(ok::INT) AS ok FROM c GROUP BY ALL),
    k AS (SELECT w.version, count_if(a.ok - coalesce(b.ok, 0) > 0.1) AS rules_lost FROM w JOIN u a ON a.version = w.parent LEFT JOIN u b ON b.version = w.version AND b.rule_id = a.rule_id GROUP BY w.version),
    o AS (SELECT w.version, w.parent, round(a.ok - p.ok, 6) AS gain, k.rules_lost, concat_ws(',', CASE WHEN a.ok - p.ok < 0.05 THEN 'gain too small' END, CASE WHEN a.structural < p.structural THEN 'structural rate fell' END,
        CASE WHEN a.fresh < p.fresh THEN 'non-duplicate rate fell' END, CASE WHEN k.rules_lost > 0 THEN 'a rule lost too much' END) AS reasons
        FROM w JOIN v a ON a.version = w.version JOIN v p ON p.version = w.parent JOIN k ON k.version = w.version)
    SELECT *, reasons = '' AS promoted FROM o"""
)
def promotion_gates(spark: SparkSession, base: str) -> DataFrame:
    rows = _traces(spark, base).where("rule_id is not null and model is not null")
    return reports.promotion_gates(rows.select(F.col("model").alias("version"), "rule_id", _ok().alias("ok"), (F.col("error_category") != "structure").alias("structural"), (F.col("error_category") != "duplicate").alias("fresh")))


@query(
    f"""WITH f AS (SELECT DISTINCT idx, rule_id, question, answer, left({s_strip('question')}, 200) AS k FROM final_records),
    e AS (SELECT DISTINCT rule_id, left({s_strip('question')}, 200) AS k FROM eval_records WHERE question IS NOT NULL),
    a AS (SELECT k, min(idx) AS first FROM f WHERE k IS NOT NULL GROUP BY k),
    p AS (SELECT idx, 0 AS kind, 'bad_format' AS problem FROM f WHERE NOT coalesce({s_wrapped('answer')}, false)
        UNION ALL SELECT idx, 1, 'DUP_OF_EVAL' FROM f JOIN e USING (rule_id, k) UNION ALL SELECT idx, 2, 'DUP_INTRA' FROM f JOIN a USING (k) WHERE idx > first)
    SELECT idx, row_number() OVER (ORDER BY idx, kind) AS position, problem FROM p QUALIFY position <= 30"""
)
def verification_problems(spark: SparkSession, base: str) -> DataFrame:
    return reports.problems(_finals(spark, base), _evals(spark, base), "idx")


def _s_tools(rule: str) -> str:
    own = " ".join(f"WHEN '{k}' THEN [{s_list(v)}]" for k, v in fixed.RULE_TOOLS.items())
    return f"list_concat(CASE {rule} {own} ELSE [] END, list_filter([{s_list(fixed.DEFAULT_TOOLS)}], lambda v: NOT list_contains(CASE {rule} {own} ELSE [] END, v)))"


_S_ROLE = "CASE agent_role " + " ".join(f"WHEN '{k}' THEN [{s_list(v)}]" for k, v in fixed.ROLE_TOOLS.items()) + " ELSE [] END"


@query(f"SELECT rule_id, array_to_string({_s_tools('rule_id')}, ',') AS tools FROM (SELECT DISTINCT rule_id FROM eval_records)")
def rule_tools(spark: SparkSession, base: str) -> DataFrame:
    return _evals(spark, base).select("rule_id").distinct().select("rule_id", F.array_join(reports.recommended_tools(F.col("rule_id")), ",").alias("tools"))


@query(
    f"""WITH {T}, d AS (SELECT DISTINCT agent_role, rule_id FROM t), x AS (SELECT agent_role, rule_id, {_S_ROLE} AS own, CASE WHEN agent_role = 'solver' AND rule_id IS NOT NULL THEN {_s_tools('rule_id')} ELSE [] END AS more FROM d)
    SELECT agent_role, rule_id, array_to_string(list_concat(own, list_filter(more, lambda v: NOT list_contains(own, v))), ',') AS tools FROM x"""
)
def role_tools(spark: SparkSession, base: str) -> DataFrame:
    rows = _traces(spark, base).select("agent_role", "rule_id").distinct()
    return rows.select("agent_role", "rule_id", F.array_join(reports.role_tools(F.col("agent_role"), F.col("rule_id")), ",").alias("tools"))


@query(
    f"""WITH {T}, m AS (SELECT trace_id, attempt, CASE WHEN attempt % 3 = 0 THEN 'HTTP 429 ' ELSE '' END || coalesce(error_category, '') || CASE WHEN attempt % 3 = 1 THEN ' Timeout' ELSE '' END AS message FROM t)
    SELECT trace_id, attempt, round(CASE WHEN regexp_matches(lower(message), 'rate|429') THEN pow(1.5, attempt) WHEN regexp_matches(lower(message), 'timeout|503') THEN pow(1.5, attempt + 1) END, 6) AS delay FROM m"""
)
def backoff_delays(spark: SparkSession, base: str) -> DataFrame:
    """Delays of the calls, if every third attempt had met a rate limit and every third a timeout."""
    third = F.pmod(F.col("attempt"), F.lit(3))
    message = F.concat(F.when(third == 0, "HTTP 429 ").otherwise(""), F.coalesce("error_category", F.lit("")), F.when(third == 1, " Timeout").otherwise(""))
    return _traces(spark, base).select("trace_id", "attempt", F.round(reports.backoff(F.col("attempt"), message), 6).alias("delay"))


@query(f"WITH {T} SELECT trace_id, 'tr-' || lpad(row_number() OVER (ORDER BY trace_id)::VARCHAR, greatest(4, length(row_number() OVER (ORDER BY trace_id)::VARCHAR))::INT, '0') AS number FROM t")
def trace_numbers(spark: SparkSession, base: str) -> DataFrame:
    """Traces with sequential identifiers in the order of their keys."""
    rows = curation.numbered(_traces(spark, base).select("trace_id", F.lit("all").alias("rule_id")), ["trace_id"])
    n = F.regexp_extract("idx", r"(\d+)$", 1)
    return rows.select("trace_id", F.concat(F.lit("tr-"), F.lpad(n, F.greatest(F.lit(4), F.length(n)), F.lit("0"))).alias("number"))


@query(
    f"""WITH {L}, b AS (SELECT session_id, rule_id, count(*) AS n, count_if(coalesce(passed, false)) AS passed, min(id) AS first FROM l WHERE session_id IS NOT NULL GROUP BY ALL),
    k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY first DESC) <= 3)
    SELECT session_id, string_agg('Rule ' || coalesce(rule_id, '?') || ': ' || passed || '/' || n || ' passed', chr(10) ORDER BY first) AS description FROM k GROUP BY session_id"""
)
def session_descriptions(spark: SparkSession, base: str) -> DataFrame:
    return reports.described_sessions(_log(spark, base))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p[0]}', '{','.join(p[3])}', '{','.join(p[4])}', true)" for p in fixed.PROBES) + ") v(probe, actions, rules, passed)")
def probe_run(spark: SparkSession, base: str) -> DataFrame:
    """The probes of the reading of intents: what was read, and whether it is what is expected."""
    asked = spark.createDataFrame(fixed.PROBES, "probe string, request string, context string, expected array<string>, expected_rules array<string>, bucket string")
    read = intents.intents_of(asked, "request", "probe", "context")
    listed = F.array_sort(F.collect_list(F.struct("position", "action", "rule_id", "bucket")))
    got = read.groupBy("probe").agg(listed.alias("read"))
    rows = asked.join(got, "probe", "left")
    actions = F.transform("read", lambda x: x["action"])
    rules = F.array_compact(F.transform("read", lambda x: x["rule_id"]))
    n = F.size("expected_rules")
    ok = (actions == F.col("expected")) & (F.slice(rules, 1, F.greatest(n, F.lit(1))) == F.col("expected_rules")).__or__(n == 0)
    ok &= (F.col("bucket") == "") | F.exists("read", lambda x: x["bucket"] == F.col("bucket"))
    return rows.select("probe", F.array_join(actions, ",").alias("actions"), F.array_join(rules, ",").alias("rules"), F.coalesce(ok, F.lit(False)).alias("passed"))


#: Puzzles with one solution each, and what is known of them without the solvers.
_SUDOKU = "53..7....6..195....98....6.8...6...34..8.3..17...2...6.6....28....419..5....8..79"
_SUDOKU_DONE = "5 3 4 6 7 8 9 1 2,6 7 2 1 9 5 3 4 8,1 9 8 3 4 2 5 6 7,8 5 9 7 6 1 4 2 3,4 2 6 8 5 3 7 9 1,7 1 3 9 2 4 8 5 6,9 6 1 5 3 7 2 8 4,2 8 7 4 1 9 6 3 5,3 4 5 2 8 6 1 7 9"
_CASES = [
    ("arithmetic", "(6+3)*(5-2)", "27.0"), ("arithmetic", "8÷4×3", "6.0"), ("arithmetic", "1/0", "error"), ("cryptarithm", "SEND+MORE=MONEY", "D=7 E=5 M=1 N=6 O=0 R=8 S=9 Y=2"), ("latin", "1 0 0,0 0 1,0 1 0", "1 2 3,2 3 1,3 1 2"),
    ("latin", "1 0 0,0 0 2,0 1 0", "none"), ("mines", "1X/11", "1M/11"), ("mines", "0X", "0S"), ("points", "1 1 1 1", "no"), ("points", "3 3 8 8", "yes"), ("points", "9 5 2 2", "yes"), ("skyscraper", "3|1 2 2|3 1 2|1 2 2|3 1 2", "3 2 1,2 1 3,1 3 2"),
    ("stars", "5|AABBB AABBC DDBCC DEECC DEEEC|1", "checked"), ("sudoku", _SUDOKU, _SUDOKU_DONE), ("sudoku", "12", "none"), ("word", "ABCDE FGHIJ KLMNO PQRST UVWXY|MGA", "3 3 1 1 NW"), ("word", "ABCDE FGHIJ KLMNO PQRST UVWXY|XYZ", "none"),
]


def _stars_hold(solution: str | None, regions: list[str]) -> bool:
    """Whether one star stands in every row, column and region, and none beside another."""
    at = [tuple(int(x) - 1 for x in s.split(":")) for s in (solution or "").split()]
    apart = all(max(abs(a - c), abs(b - d)) > 1 for i, (a, b) in enumerate(at) for c, d in at[:i])
    return apart and len(at) == len({a for a, _ in at}) == len({b for _, b in at}) == len({regions[a][b] for a, b in at}) == len(regions)


def _solved(kind: str, data: str) -> str:
    if kind == "arithmetic":
        value, error = solvers.evaluate(data)
        return "error" if error else str(float(value))
    if kind == "cryptarithm":
        left, result = data.split("=")
        found = solvers.solve_sum(left.split("+"), result)
        return " ".join(f"{k}={v}" for k, v in sorted(found[0].items())) if len(found) == 1 else "none"
    if kind == "points":
        return "yes" if solvers.solve_24([int(x) for x in data.split()]) else "no"
    if kind == "mines":
        return solvers.solve_mines(data.split("/"))["board"].replace("\n", "/")
    if kind == "word":
        grid, word = data.split("|")
        found = solvers.find_word(grid.split(), word)
        return " ".join(map(str, found)) if found else "none"
    if kind == "stars":
        n, regions, stars = data.split("|")
        return "checked" if _stars_hold(solvers.solve_stars(int(n), regions.split(), int(stars))["solution"], regions.split()) else "none"
    if kind == "skyscraper":
        n, *clues = data.split("|")
        out = solvers.solve_skyscraper(int(n), *[[int(x) for x in c.split()] for c in clues])
    else:
        out = solvers.solve_sudoku(data) if kind == "sudoku" else solvers.solve_latin(data)
    return out["solution"] if out["solved"] else "none"


@query("SELECT * FROM (VALUES " + ", ".join("('" + "', '".join(c) + "')" for c in _CASES) + ") v(kind, puzzle, solution)")
def solver_examples(spark: SparkSession, base: str) -> DataFrame:
    """Every solver on puzzles whose solutions are known."""
    asked = spark.createDataFrame([c[:2] for c in _CASES], "kind string, puzzle string")
    solve = F.udf(_solved, "string")  # a handful of puzzles
    return asked.select("kind", "puzzle", solve("kind", "puzzle").alias("solution"))
