"""Run analytics: counts and rates by rule, role and session, reasons, scores, comparisons of versions and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.functions import fixed, text


def rate(good: Column, all_: Column, digits: int = 6) -> Column:
    """A share, with a denominator of at least 1."""
    return F.round(good / F.greatest(all_, F.lit(1)), digits)


def reasons(df: DataFrame, errors: str, order: str, by: list[str] = ()) -> DataFrame:
    """(by..., reason, n, first) of the reason heads; ``first`` is the least ``order`` with which a reason appears."""
    heads = df.select(*by, F.col(order).alias("_at"), F.explode(errors).alias("_reason"))
    return heads.groupBy(*by, text.reason_head("_reason").alias("reason")).agg(F.count("*").alias("n"), F.min("_at").alias("first"))


def top_reasons(df: DataFrame, errors: str, order: str, k: int = 10) -> DataFrame:
    """The k most frequent reasons, ties by first appearance."""
    return reasons(df, errors, order).orderBy(F.desc("n"), "first", "reason").limit(k).select("reason", "n")


def rule_dimension(spark) -> DataFrame:
    return spark.createDataFrame([(r,) for r in fixed.RULES], "rule_id string").withColumn("category", text.category("rule_id"))


def per_rule(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each of the 25 rules, also those without rows: accepted, rejected, accept_rate, structural, crosscheck, avg_score.

    ``accepted`` has rule_id, structural_ok (true by default), crosscheck_ok (false by default), reviewer_score (0 by
    default); ``rejected`` has rule_id.
    """
    good = accepted.groupBy("rule_id").agg(
        F.count("*").alias("accepted"),
        F.count_if(F.coalesce("structural_ok", F.lit(True))).alias("structural_passed"),
        F.count_if(F.coalesce("crosscheck_ok", F.lit(False))).alias("crosscheck_passed"),
        F.round(F.avg(F.coalesce("reviewer_score", F.lit(0)).cast("double")), 3).alias("avg_score"),
    )
    bad = rejected.groupBy("rule_id").agg(F.count("*").alias("rejected"))
    out = rule_dimension(accepted.sparkSession).select("rule_id").join(good, "rule_id", "left").join(bad, "rule_id", "left")
    out = out.fillna(0, ["accepted", "rejected", "structural_passed", "crosscheck_passed", "avg_score"])
    return out.withColumn("accept_rate", rate(F.col("accepted"), F.col("accepted") + F.col("rejected")))


def totals(accepted: DataFrame, rejected: DataFrame, requested: int, elapsed: float) -> DataFrame:
    """One row of totals and scores of a run. Duplicates count reasons, so a row that is one twice counts twice."""
    a = accepted.agg(
        F.count("*").alias("accepted"),
        F.count_if(F.coalesce("structural_ok", F.lit(True))).alias("structural_passed"),
        F.count_if(F.coalesce("crosscheck_ok", F.lit(False))).alias("crosscheck_passed"),
    )
    dup = F.size(F.filter(F.coalesce("errors", F.array().cast("array<string>")), lambda r: F.startswith(r, F.lit("duplicate"))))
    r = rejected.agg(F.count("*").alias("rejected"), F.coalesce(F.sum(dup), F.lit(0)).alias("duplicates"))
    both = a.join(r, F.lit(True))
    return scored(both.select("*", F.lit(requested).cast("bigint").alias("requested"), (F.col("accepted") + F.col("rejected")).alias("attempts"), F.lit(elapsed).alias("elapsed")))


def scored(t: DataFrame) -> DataFrame:
    """Rates and the weighted score of totals; every denominator is at least 1."""
    one = lambda c: F.greatest(F.col(c), F.lit(1))
    s = {
        "accept": F.col("accepted") / one("requested"),
        "structural": F.col("structural_passed") / one("attempts"),
        "crosscheck": F.col("crosscheck_passed") / one("accepted"),
        "non_duplicate": F.greatest(F.lit(0.0), 1 - F.col("duplicates") / one("attempts")),
        "latency": text.latency_score(F.col("elapsed"), F.col("requested")),
    }
    overall = sum((s[k] * w for k, w in fixed.SCORE_WEIGHTS.items()), F.lit(0.0))
    return t.select("*", *[F.round(v, 6).alias(f"{k}_rate") for k, v in s.items()], F.round(overall, 6).alias("overall"))


def advice(df: DataFrame, errors: str, order: str) -> DataFrame:
    """All kinds of failure with their counts and the advice, most frequent first."""
    heads = reasons(df, errors, order)
    kinds = heads.groupBy(text.failure_kind("reason").alias("failure")).agg(F.sum("n").alias("n"))
    return kinds.withColumn("action", text.action("failure")).orderBy(F.desc("n"), "failure")


def ranked_failures(advised: DataFrame, counted: DataFrame) -> DataFrame:
    """(failure, priority): first the advised failures in their order, then the others by count."""
    a = advised.select("failure", F.lit(0).alias("part"), F.col("n"))
    c = counted.select(F.col("reason").alias("failure"), F.lit(1).alias("part"), "n").join(a, "failure", "left_anti")
    return a.unionByName(c)


def pass_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., total, passed, rate); a null outcome hasn't passed."""
    out = df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"))
    return out.withColumn("rate", rate(F.col("passed"), F.col("total"), 3))


def session_rules(df: DataFrame) -> DataFrame:
    """Per session the totals of every rule and, with a null rule, of the session, in one pass over the rows."""
    spark = df.sparkSession
    rows = spark.sql("select session_id, rule_id, count(*) as total, count_if(coalesce(passed, false)) as passed, grouping(rule_id) as whole from {log} where session_id is not null group by grouping sets ((session_id, rule_id), (session_id))", log=df)
    return rows.withColumn("rate", rate(F.col("passed"), F.col("total"), 3))


def recent_top(df: DataFrame, last: int, k: int) -> DataFrame:
    """Rules of the ``last`` newest rows, the k most frequent."""
    newest = df.orderBy(F.desc_nulls_last("created_at"), "id").limit(last)
    return newest.groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("rule_id")).limit(k)


def trace_summary(traces: DataFrame) -> DataFrame:
    """Calls, failures and pass share by role, and over all roles with a null role."""
    failed = F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0
    rows = traces.select("agent_role", failed.alias("failed")).rollup("agent_role").agg(F.count("*").alias("calls"), F.count_if("failed").alias("failures"), F.grouping("agent_role").alias("whole"))
    return rows.withColumn("pass_rate", F.format_string("%.1f%%", F.round((F.col("calls") - F.col("failures")) / F.greatest(F.col("calls"), F.lit(1)) * 100, 1)))


def training_report(traces: DataFrame, high: float = 0.30, medium: float = 0.10) -> DataFrame:
    """Per rule: calls, failure rate, the three most frequent error heads, priority and samples to collect."""
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    calls = traces.groupBy("rule_id").agg(F.count("*").alias("calls"), F.count_if(F.size(errors) > 0).alias("failures"))
    heads = reasons(traces.withColumn("_errors", errors), "_errors", "trace_id", ["rule_id"])
    place = Window.partitionBy("rule_id").orderBy(F.desc("n"), "first", "reason")
    three = heads.withColumn("_place", F.row_number().over(place)).where("_place <= 3")  # kept before the shuffle
    listed = F.array_sort(F.collect_list(F.struct("_place", F.concat("reason", F.lit("="), F.col("n").cast("string")).alias("text"))))
    tops = three.groupBy(F.col("rule_id").alias("_rule")).agg(F.array_join(F.transform(listed, lambda x: x["text"]), ",").alias("top_errors"))
    share = F.col("failures") / F.col("calls")
    out = calls.join(tops, F.col("rule_id").eqNullSafe(F.col("_rule")), "left")
    return out.select(
        "rule_id", "calls", F.round(share, 6).alias("failure_rate"), F.coalesce("top_errors", F.lit("")).alias("top_errors"),
        F.when(share > high, "HIGH").when(share > medium, "MEDIUM").otherwise("LOW").alias("priority"),
        (F.col("failures") * 2).alias("samples"), F.least(F.col("failures") * 2, F.lit(100)).alias("samples_estimate"),
    )


def compared(results: DataFrame, parent: str, candidate: str) -> DataFrame:
    """(test, outcome) of two versions: regression, improvement, both_fail or both_pass. ``results`` has version, test, ok."""
    p = results.where(F.col("version") == parent).select("test", F.col("ok").alias("before"))
    c = results.where(F.col("version") == candidate).select("test", F.col("ok").alias("after"))
    both = p.join(c, "test")
    return both.select("test", F.when(F.col("before") & ~F.col("after"), "regression").when(~F.col("before") & F.col("after"), "improvement").when(F.col("after"), "both_pass").otherwise("both_fail").alias("outcome"))


def version_gate(rules: DataFrame, parent: str, candidate: str, least_gain: float = 0.05, most_loss: float = 0.10) -> DataFrame:
    """One row: gain of the candidate's pass rate, its largest loss on a rule, and the reasons against it.

    ``rules`` has version, rule_id, total, passed. A rule that the candidate lacks counts with rate 0.
    """
    p = rules.where(F.col("version") == parent).select("rule_id", F.col("total").alias("tp"), F.col("passed").alias("pp"))
    c = rules.where(F.col("version") == candidate).select("rule_id", F.col("total").alias("tc"), F.col("passed").alias("pc"))
    j = p.join(c, "rule_id", "left").fillna(0, ["tc", "pc"])
    loss = F.col("pp") / F.col("tp") - F.col("pc") / F.greatest("tc", F.lit(1))
    a = j.agg(
        F.round(F.sum("pc") / F.greatest(F.sum("tc"), F.lit(1)) - F.sum("pp") / F.greatest(F.sum("tp"), F.lit(1)), 6).alias("gain"),
        F.round(F.max(loss), 6).alias("largest_loss"), F.count_if(loss > most_loss).alias("rules_lost"),
    )
    reasons_ = F.concat_ws(",", F.when(F.col("gain") < least_gain, "gain too small"), F.when(F.col("rules_lost") > 0, "a rule lost too much"))
    return a.withColumn("reasons", reasons_).withColumn("passed", F.col("reasons") == "")


def best_candidate(scores: DataFrame) -> DataFrame:
    """The passing row with the highest score; of equal ones the first by position."""
    return scores.where("passed").orderBy(F.desc("score"), "position").limit(1)
