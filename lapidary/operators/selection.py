"""Choosing and describing: few-shot examples, token budgets, plans, jobs, progress, quality, profiles as text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidary.functions import fixed, text


def few_shot(evals: DataFrame, wanted: str, k: int) -> DataFrame:
    """(rule_id, item_id, position): the k examples of each rule for prompts of a bucket: those of the bucket first, then the others,
    in an order that is fixed but doesn't follow the ids."""
    rows = evals.where("question is not null").select("rule_id", "item_id", text.bucket("question").alias("bucket"))
    order = [F.when(F.col("bucket") == wanted, 0).otherwise(1), F.md5(F.col("item_id").cast("string"))]
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("rule_id").orderBy(*order))).where(F.col("position") <= k).drop("bucket")


def within_budget(df: DataFrame, by: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """Rows of each group as long as their sizes, summed in order, stay within the budget."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def tiled(values: list[str], count: Column) -> Column:
    """The values over and over, up to a number of entries."""
    all_ = F.array(*[F.lit(v) for v in values])
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.get(all_, F.pmod(i, F.lit(len(values))).cast("int")))).otherwise(F.array().cast("array<string>"))


def matches(features: Column, target: Column) -> Column:
    """Whether two maps agree on every key of the target that both have; keys that start with an underscore don't count."""
    shared = F.filter(F.map_entries(target), lambda e: ~F.startswith(e["key"], F.lit("_")) & F.map_contains_key(features, e["key"]))
    return F.forall(shared, lambda e: F.element_at(features, e["key"]).eqNullSafe(e["value"]))


def zipped(a: Column, b: Column) -> Column:
    """Pairs of two arrays by position, as many as the shorter one has."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))), F.lit(1), n)


def top_of_map(m: Column, k: int) -> Column:
    """The k largest entries of a map to integers: by value, the largest first, then by key."""
    order = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.transform(F.slice(order, 1, k), lambda x: F.struct(x["k"].alias("key"), (-x["v"]).alias("value")))


def glob(pattern: str) -> str:
    """A shell pattern with * and ? as a regular expression for a whole value."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + r"\z"


def jobs(intents: DataFrame, key: str, known: list[str]) -> DataFrame:
    """(key, rules, count) of every request: its distinct known rules in order; the count of the last GENERATE intent holds for all.

    Without any known rule all rules are meant. Requests without a GENERATE intent have no job.
    """
    made = intents.where("action = 'GENERATE'")
    rows = made.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("rule_id").isin(known), F.struct("position", "rule_id")))).alias("named"), F.max_by("count", "position").alias("count")
    )
    rules = F.array_distinct(F.transform("named", lambda x: x["rule_id"]))
    return rows.select(key, F.when(F.size(rules) > 0, rules).otherwise(F.array(*[F.lit(r) for r in known])).alias("rules"), "count")


def progress(log: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session: completed, passed and failed rows, the rate, and what is left of its total."""
    done = log.where("session_id is not null").groupBy(F.col("session_id").alias("id")).agg(
        F.count("*").alias("completed"), F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"), F.count_if(~F.coalesce("passed", F.lit(True))).alias("failed")
    )
    j = sessions.select("id", "total_generated").join(done, "id", "left").fillna(0, ["completed", "passed", "failed"])
    left = F.greatest(F.coalesce("total_generated", F.lit(0)) - F.col("completed"), F.lit(0))
    return j.select("id", "completed", "passed", "failed", F.round(F.col("passed") / F.greatest("completed", F.lit(1)), 3).alias("rate"), left.cast("bigint").alias("left"))


def quality(records: DataFrame) -> DataFrame:
    """``records`` with status: fail (structure), low (a score below 5; none isn't low), else pass."""
    score, ok = F.col("reviewer_score"), F.coalesce("structural_ok", F.lit(True))
    return records.withColumn("status", F.when(~ok, "fail").when(score < 5, "low").otherwise("pass"))


def feedback(c: Column | str) -> Column:
    """What a text says about preferences: the difficulty, and changes of categories and rules as (kind, key, delta)."""
    t = F.col(c) if isinstance(c, str) else c
    low = F.lower(t)

    def any_(words):
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    level = F.when(any_(["难一点", "困难", "复杂", "hard"]), "hard").when(any_(["简单", "容易", "短一点", "easy"]), "easy").when(any_(["中等", "普通", "medium"]), "medium")
    tags = {"math": ["数学", "计算", "24点", "math"], "word": ["字谜", "词", "文字", "word"], "spatial": ["空间", "网格", "迷宫", "spatial"], "logic": ["逻辑", "推理", "logic"]}
    change = lambda kind, key, delta: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(delta).alias("delta"))
    of_tags = F.array_compact(F.array(*[F.when(any_(words), change("tag", F.lit(name), 2)) for name, words in tags.items()]))
    named = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(name)), F.lit(rule)) for name, rule in fixed.FEEDBACK_NAMES.items()]))
    rules = F.concat(text.mentioned_rules(t), named)
    of_rules = F.flatten(F.transform(rules, lambda r: F.array(change("rule", r, 3), change("tag", text.category(r), 1))))
    return F.struct(level.alias("difficulty"), F.concat(of_tags, of_rules).alias("changes"))


def profile_text(user: Column, difficulty: Column, rules: Column, tags: Column, most: int = 1200) -> Column:
    """A profile as lines of text, cut to ``most`` characters with three points at the end."""
    listed = lambda m, k, lead: F.array_join(F.transform(top_of_map(m, k), lambda x: F.concat(F.lit(lead), x["key"], F.lit(":"), x["value"].cast("string"))), ", ")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("user_id="), user), F.when(difficulty != "auto", F.concat(F.lit("difficulty_preference="), difficulty)),
        F.when(F.size(rules) > 0, F.concat(F.lit("preferred_rules="), listed(rules, 5, "R"))), F.when(F.size(tags) > 0, F.concat(F.lit("preferred_tags="), listed(tags, 5, ""))),
    )
    return F.when(F.length(lines) > most, F.concat(F.substring(lines, 1, most - 3), F.lit("..."))).otherwise(lines)


def version_or_builtin(registry: DataFrame, version: str, builtin: dict[str, str]) -> DataFrame:
    """The row of a version (version_id, prompts), or the builtin one where there is none."""
    spark = registry.sparkSession
    found = registry.where(F.col("version_id") == version).select("version_id", "prompts").limit(1)
    default = spark.range(1).select(F.lit("builtin").alias("_id"), F.create_map(*[F.lit(x) for kv in builtin.items() for x in kv]).alias("_prompts"))
    joined = default.join(found, F.lit(True), "left")
    return joined.select(F.coalesce("version_id", "_id").alias("version_id"), F.coalesce("prompts", "_prompts").alias("prompts"))


def free_digits(cells: Column, index: int) -> Column:
    """Digits that a cell of a sudoku (81 integers) may still take by its row, column and box."""
    r, c = divmod(index, 9)
    peers = sorted({9 * r + k for k in range(9)} | {9 * k + c for k in range(9)} | {9 * (3 * (r // 3) + i) + 3 * (c // 3) + j for i in range(3) for j in range(3)})
    return F.array_except(F.sequence(F.lit(1), F.lit(9)), F.array(*[F.get(cells, F.lit(p)) for p in peers]))
