"""Curation of records: checks against the held-out set, first-wins deduplication, the acceptance gate, verification.

No operator holds a group in one place: first occurrences come from an aggregation over (key, order) and a join that
adaptive execution can split, so a key that a third of all rows share costs one pre-aggregated row. The held-out set is
joined by key; whether it is broadcast is left to the optimizer, which knows its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapidary.functions import grids, text
from lapidary.operators.joins import split_join
from lapidary.session import durable


def calibration(evals: DataFrame) -> DataFrame:
    """Lengths of the held-out questions and answers by rule. Null texts are left out of the figures."""
    q, a = F.length("question"), F.length("answer")
    return evals.groupBy("rule_id").agg(
        F.count("*").alias("n_examples"), F.min(q).alias("q_len_min"), F.max(q).alias("q_len_max"), F.round(F.avg(q), 4).alias("q_len_avg"),
        F.min(a).alias("a_len_min"), F.max(a).alias("a_len_max"),
    )


def in_heldout(records: DataFrame, evals: DataFrame, key=text.fingerprint) -> DataFrame:
    """Records whose question has the key of a held-out question (left semi join)."""
    keys = evals.where("question is not null").select(key("question").alias("_key")).distinct()
    return records.withColumn("_key", key("question")).transform(split_join, keys, ["_key"], "left_semi").drop("_key")


def not_in_heldout(records: DataFrame, evals: DataFrame, key=text.fingerprint) -> DataFrame:
    """The other records (left anti join); null questions stay."""
    keys = evals.where("question is not null").select(key("question").alias("_key")).distinct()
    return records.withColumn("_key", key("question")).transform(split_join, keys, ["_key"], "left_anti").drop("_key")


def with_first(records: DataFrame, key: Column, order: list[str], name: str = "is_first") -> DataFrame:
    """``records`` with whether a row is the first of its key by ``order`` (which must tell rows apart). A null key is always first."""
    keyed = records.withColumn("_key", key)
    first = keyed.where("_key is not null").groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"))
    joined = split_join(keyed, first, ["_key"])
    return joined.withColumn(name, F.col("_key").isNull() | (F.struct(*order) == F.col("_first"))).drop("_key", "_first")


def first_of_each(records: DataFrame, key: Column, order: list[str]) -> DataFrame:
    return with_first(records, key, order, "_is_first").where("_is_first").drop("_is_first")


def gate(candidates: DataFrame, evals: DataFrame, order: list[str], answer_error: Column | None = None) -> DataFrame:
    """``candidates`` with accepted and reasons.

    Reasons, in this order: generation_failed (question or answer null), bad_answer_format, structural_invalid with the
    error, duplicate_of_eval, duplicate_of_accepted, difficulty_too_easy (more than 200 characters shorter than the
    shortest held-out question of the rule; rules without examples have no bound). Only rows without any other reason
    make later rows duplicates. ``order`` settles which row is the first; it must tell rows apart.
    """
    error = grids.answer_error("rule_id", "answer") if answer_error is None else answer_error
    heldout = evals.where("question is not null").select(text.fingerprint("question").alias("_print")).distinct().withColumn("_held", F.lit(True))
    bounds = calibration(evals).select("rule_id", F.col("q_len_min").alias("_least"))
    rows = candidates.withColumn("_print", text.fingerprint("question")).withColumn("_error", error)
    rows = split_join(split_join(rows, heldout, ["_print"]), bounds, ["rule_id"])
    failed = F.col("question").isNull() | F.col("answer").isNull()
    easy = (F.col("_least") > 0) & (F.length("question") < F.col("_least") - 200)
    before = F.array_compact(
        F.array(
            F.when(failed, "generation_failed"),
            F.when(~failed & ~text.is_wrapped("answer"), "bad_answer_format"),
            F.when(~failed & F.col("_error").isNotNull(), F.concat(F.lit("structural_invalid: "), F.col("_error"))),
            F.when(~failed & F.col("_held"), "duplicate_of_eval"),
        )
    )
    after = F.array_compact(F.array(F.when(~failed & easy, "difficulty_too_easy")))
    rows = rows.withColumn("_before", before).withColumn("_after", after)
    clean = (F.size("_before") == 0) & (F.size("_after") == 0)
    first = rows.where(clean).groupBy("_print").agg(F.min(F.struct(*order)).alias("_first"))
    rows = split_join(rows, first, ["_print"])
    # A row comes after the first accepted one of its question.
    repeated = F.when(F.coalesce(F.struct(*order) > F.col("_first"), F.lit(False)) & ~failed, "duplicate_of_accepted")
    reasons = F.concat(F.col("_before"), F.array_compact(F.array(repeated)), F.col("_after"))
    return rows.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0).drop("_print", "_error", "_held", "_least", "_before", "_after", "_first")


def structural_gate(candidates: DataFrame) -> DataFrame:
    """``candidates`` with accepted: the answer is wrapped and passes the check of its rule. No duplicates are looked for."""
    return candidates.withColumn("accepted", text.is_wrapped("answer") & grids.answer_error("rule_id", "answer").isNull())


def verification(records: DataFrame, evals: DataFrame, order: list[str], crosscheck: Column) -> DataFrame:
    """Per rule: records, well-formatted ones, those not in the held-out set, first occurrences, those that passed the cross-check."""
    keys = evals.where("question is not null").select(text.fingerprint("question").alias("_print")).distinct().withColumn("_held", F.lit(True))
    flagged = with_first(records.withColumn("_print", text.fingerprint("question")), F.col("_print"), order, "_is_first").transform(split_join, keys, ["_print"])
    return flagged.groupBy("rule_id").agg(
        F.count("*").alias("n"),
        F.count_if(text.is_wrapped("answer")).alias("n_format"),
        F.count_if(F.col("_held").isNull()).alias("n_no_eval_dup"),
        F.count_if("_is_first").alias("n_no_intra_dup"),
        F.count_if(F.coalesce(crosscheck, F.lit(False))).alias("n_crosscheck"),
    )


def numbered(accepted: DataFrame, order: list[str]) -> DataFrame:
    """``accepted`` with idx ``syn-<rule>-<n>``, n the position within the rule.

    Positions come from a range-partitioned sort and prefix sums of the partitions' counts, so a large rule spreads.
    """
    from pyspark.sql import Window

    ranged = accepted.repartitionByRange("rule_id", *order).sortWithinPartitions("rule_id", *order).withColumn("_part", F.spark_partition_id())
    # Written once: both uses below must see the same partitions.
    local = durable(ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part", "rule_id").orderBy(*order))))
    sizes = local.groupBy("rule_id", "_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy("rule_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    placed = local.join(before, ["rule_id", "_part"])
    return placed.withColumn("idx", F.concat(F.lit("syn-"), F.col("rule_id"), F.lit("-"), (F.col("_n") + F.col("_before")).cast("string"))).drop("_part", "_n", "_before")


def rule_index(evals: DataFrame) -> DataFrame:
    """One row per rule: title, tag and content of its first example, all examples by id, and the calibration.

    The held-out set is a bounded list per rule, so its examples are nested. Rules without examples have no row.
    """
    first = lambda c: F.min_by(c, "item_id").alias(c)
    examples = F.transform(F.array_sort(F.collect_list(F.struct("item_id", "question", "answer"))), lambda e: F.struct(e["question"], e["answer"]))
    nested = evals.groupBy("rule_id").agg(first("title"), first("tag"), first("rule_content"), examples.alias("examples"))
    return nested.join(calibration(evals), "rule_id")


def inspected(evals: DataFrame, rule: str, question: int = 300, answer: int = 100) -> DataFrame:
    """Title, tag, calibration and the first example, cut short, of a rule; for an unknown rule one row with an error."""
    spark = evals.sparkSession
    index = rule_index(evals).where(F.col("rule_id") == rule)
    shown = index.select("rule_id", "title", "tag", "q_len_min", "q_len_max", F.substring(F.col("examples")[0]["question"], 1, question).alias("question"), F.substring(F.col("examples")[0]["answer"], 1, answer).alias("answer"))
    asked = spark.range(1).select(F.lit(rule).alias("rule_id"))
    return asked.join(shown, "rule_id", "left").withColumn("error", F.when(F.col("title").isNull(), "unknown rule"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (which must tell rows apart)."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return top.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both; where a key is in both, the row of ``new`` (its last by ``order``)."""
    both = old.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, ["_at", *order]).drop("_at")
