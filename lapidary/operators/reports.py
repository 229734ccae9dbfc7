"""Reports over versions, outputs and sessions, and the gates that decide by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.functions import fixed, text
from lapidary.operators.joins import split_join


def with_parent(results: DataFrame) -> DataFrame:
    """(version, parent): every version and the one before it by name; the first has none."""
    return results.select("version").distinct().withColumn("parent", F.lag("version").over(Window.orderBy("version")))


def _against(tests: DataFrame) -> DataFrame:
    """``tests`` (version, rule_id, test, ok) with the parent's outcome of the same test, null where it has none."""
    before = tests.select(F.col("version").alias("parent"), "rule_id", "test", F.col("ok").alias("before"))
    return tests.join(with_parent(tests), "version").join(before, ["parent", "rule_id", "test"], "left")


def version_reports(tests: DataFrame) -> DataFrame:
    """Per version: tests, passed, pass rate, and regressions, improvements and failures of both against its parent."""
    rows = _against(tests)
    out = rows.groupBy("version", "parent").agg(
        F.count("*").alias("total"), F.count_if("ok").alias("passed"), F.count_if(F.col("before") & ~F.col("ok")).alias("regressions"),
        F.count_if(~F.col("before") & F.col("ok")).alias("improvements"), F.count_if(~F.col("before") & ~F.col("ok")).alias("both_fail"),
    )
    return out.withColumn("pass_rate", F.col("passed") / F.greatest("total", F.lit(1)))


def rule_rates(tests: DataFrame) -> DataFrame:
    """Per version and rule: tests, passed and rate."""
    out = tests.groupBy("version", "rule_id").agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"))
    return out.withColumn("rate", F.col("passed") / F.col("total"))


def _percent(share: Column) -> Column:
    return F.bround(share * 100, 0).cast("int").cast("string")


def ci_gates(tests: DataFrame, least: float = 0.85, most_regressions: int = 0, least_rule: float = 0.70) -> DataFrame:
    """(version, passed, reason): the first reason against a version, or PASS. Of several rules the first by number counts."""
    low = rule_rates(tests).where(F.col("rate") < least_rule).groupBy("version").agg(F.min_by(F.struct("rule_id", "rate"), F.col("rule_id").cast("int")).alias("low"))
    rows = version_reports(tests).join(low, "version", "left")
    reason = (
        F.when(F.col("pass_rate") < least, F.concat(F.lit("Pass rate "), _percent(F.col("pass_rate")), F.lit(f"% < {least:.0%}")))
        .when(F.col("regressions") > most_regressions, F.concat(F.col("regressions").cast("string"), F.lit(" regressions detected")))
        .when(F.col("low").isNotNull(), F.concat(F.lit("Rule "), F.col("low.rule_id"), F.lit(" rate "), _percent(F.col("low.rate")), F.lit(f"% < {least_rule:.0%}")))
        .otherwise("PASS")
    )
    return rows.select("version", (reason == "PASS").alias("passed"), reason.alias("reason"))


def promotion_gates(calls: DataFrame, least_gain: float = 0.05, most_loss: float = 0.10) -> DataFrame:
    """Per version with a parent: gain of the accept rate, and every reason against promoting it. ``calls`` has version,
    rule_id, ok, structural (its structure was accepted) and fresh (it was no duplicate)."""
    rates = lambda *by: calls.groupBy(*by).agg(*[F.avg(F.col(c).cast("int")).alias(c) for c in ("ok", "structural", "fresh")])
    of = rates("version").join(with_parent(calls), "version").where("parent is not null")
    parent = rates("version").select(F.col("version").alias("parent"), *[F.col(c).alias(f"p_{c}") for c in ("ok", "structural", "fresh")])
    pairs = with_parent(calls).where("parent is not null")
    before = rates("version", "rule_id").select(F.col("version").alias("parent"), "rule_id", F.col("ok").alias("p_ok")).join(pairs, "parent")
    lost = before.join(rates("version", "rule_id").select("version", "rule_id", "ok"), ["version", "rule_id"], "left")
    # A rule that the candidate lacks counts with rate 0.
    lost = lost.groupBy("version").agg(F.count_if(F.col("p_ok") - F.coalesce("ok", F.lit(0.0)) > most_loss).alias("rules_lost"))
    rows = of.join(parent, "parent").join(lost, "version")
    reasons = F.concat_ws(
        ",", F.when(F.col("ok") - F.col("p_ok") < least_gain, "gain too small"), F.when(F.col("structural") < F.col("p_structural"), "structural rate fell"),
        F.when(F.col("fresh") < F.col("p_fresh"), "non-duplicate rate fell"), F.when(F.col("rules_lost") > 0, "a rule lost too much"),
    )
    rows = rows.select("version", "parent", F.round(F.col("ok") - F.col("p_ok"), 6).alias("gain"), "rules_lost", reasons.alias("reasons"))
    return rows.withColumn("promoted", F.col("reasons") == "")


def problems(records: DataFrame, evals: DataFrame, key: str, first: int = 30) -> DataFrame:
    """(key, position, problem) of the ``first`` problems by key: bad_format, DUP_OF_EVAL (within the rule), DUP_INTRA.

    Questions are compared by their first 200 characters, as the verification does. A null answer is badly formatted; a
    null question is no duplicate."""
    shown = records.withColumn("_key", F.substring(text.strip("question"), 1, 200))
    held = evals.where("question is not null").select("rule_id", F.substring(text.strip("question"), 1, 200).alias("_key")).distinct().withColumn("_held", F.lit(True))
    earliest = shown.where("_key is not null").groupBy("_key").agg(F.min(key).alias("_first"))
    rows = split_join(split_join(shown, held, ["rule_id", "_key"]), earliest, ["_key"])
    found = F.array_compact(F.array(F.when(~text.is_wrapped("answer"), "bad_format"), F.when(F.col("_held"), "DUP_OF_EVAL"), F.when(F.col(key) > F.col("_first"), "DUP_INTRA")))
    listed = rows.select(key, F.posexplode(found).alias("_at", "problem")).orderBy(key, "_at").limit(first)
    return listed.withColumn("position", F.row_number().over(Window.orderBy(key, "_at"))).select(key, "position", "problem")


def recommended_tools(rule: Column) -> Column:
    """The tools of a rule, its own first, each once."""
    own = F.create_map(*[x for k, v in fixed.RULE_TOOLS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.concat(F.coalesce(F.try_element_at(own, rule), F.array().cast("array<string>")), F.array(*map(F.lit, fixed.DEFAULT_TOOLS))))


def role_tools(role: Column, rule: Column) -> Column:
    """The tools of a role, and for solvers those of the rule after them, each once; an empty array for a role without tools of its own."""
    own = F.create_map(*[x for k, v in fixed.ROLE_TOOLS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    of_role = F.coalesce(F.try_element_at(own, role), F.array().cast("array<string>"))
    return F.when(role == "solver", F.array_distinct(F.concat(of_role, F.when(rule.isNotNull(), recommended_tools(rule)).otherwise(F.array().cast("array<string>"))))).otherwise(of_role)


def backoff(attempt: Column, message: Column, base: float = 1.5) -> Column:
    """Seconds to wait before the next attempt: base^attempt after a rate limit, base^(attempt + 1) after a timeout; null where it isn't tried again."""
    low = F.lower(message)
    return F.when(low.rlike("rate|429"), F.pow(F.lit(base), attempt)).when(low.rlike("timeout|503"), F.pow(F.lit(base), attempt + 1))


def described_sessions(log: DataFrame, last: int = 3) -> DataFrame:
    """(session_id, description): the ``last`` batches of a session, of one rule each in the order of their first rows, a line each."""
    done = F.count_if(F.coalesce("passed", F.lit(False)))
    batches = log.where("session_id is not null").groupBy("session_id", "rule_id").agg(F.count("*").alias("n"), done.alias("passed"), F.min("id").alias("first"))
    newest = batches.withColumn("_back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("first")))).where(F.col("_back") <= last)
    line = F.concat(F.lit("Rule "), F.coalesce("rule_id", F.lit("?")), F.lit(": "), F.col("passed").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" passed"))
    listed = F.array_sort(F.collect_list(F.struct("first", line.alias("line"))))
    return newest.groupBy("session_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("description"))
