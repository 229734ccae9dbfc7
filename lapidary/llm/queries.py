"""The pN_ queries, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.llm import bpe, copies, cuts, history, leaks, near, packing, pairs, sentences, top
from lapidary.sources.tables import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return leaks.leaks(table(spark, base, "documents"), table(spark, base, "final_records"), table(spark, base, "eval_records"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return copies.copies(table(spark, base, "puzzles"), table(spark, base, "final_records"), table(spark, base, "raw_records"))


def p2_collapsed(spark: SparkSession, base: str) -> DataFrame:
    return copies.collapsed(copies.records_of(table(spark, base, "puzzles"), table(spark, base, "final_records")), "tab")


def p2_collapsed_lines(spark: SparkSession, base: str) -> DataFrame:
    return copies.collapsed(copies.parsed_lines(table(spark, base, "raw_records"), "raw_id", "line"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return history.rejected_records(table(spark, base, "batch_records"), [table(spark, base, "puzzles"), table(spark, base, "final_records")])


def _whole_text():
    return F.concat_ws(" ", "question", F.coalesce("answer", F.lit("")))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return near.near_pairs(table(spark, base, "puzzles"), "id", _whole_text())


def p4_groups(spark: SparkSession, base: str) -> DataFrame:
    return near.near_groups(table(spark, base, "puzzles"), "id", _whole_text())


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return top.best_puzzles(table(spark, base, "puzzles")).select("rule_id", "created_day", "id")


def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    return bpe.encoded(table(spark, base, "documents"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return cuts.cut_values(cuts.values_of(table(spark, base, "puzzles"), table(spark, base, "call_traces")))


def p6_rates(spark: SparkSession, base: str) -> DataFrame:
    return cuts.cut_rates(table(spark, base, "puzzles"), table(spark, base, "call_traces"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return pairs.defects(table(spark, base, "puzzles"), table(spark, base, "call_traces"), table(spark, base, "documents"))


def p9_windows(spark: SparkSession, base: str) -> DataFrame:
    return packing.packed(table(spark, base, "documents"))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return sentences.split_documents(table(spark, base, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_collapsed, p2_collapsed_lines, p3_found, p4_found, p4_groups, p5_found, p6_found, p6_rates, p7_found, p8_ids, p9_windows, p10_found)}

ORACLE = {
    "p2_collapsed": """
        WITH k AS (SELECT 'puzzles' AS tab, id AS rec_key, question FROM puzzles UNION ALL SELECT 'final_records', idx, question FROM final_records),
             n AS (SELECT DISTINCT tab, rec_key, regexp_replace(lower(question), '[^\\p{L}\\p{N}]+', '', 'g') AS norm FROM k WHERE question IS NOT NULL)
        SELECT tab, min(rec_key) AS kept_key, count(*) AS n_copies FROM n GROUP BY tab, norm""",
    "p5_found": """
        WITH d AS (SELECT DISTINCT rule_id, strftime(created_at, '%Y-%m-%d') AS created_day, reviewer_score, created_at, id
                   FROM puzzles WHERE rule_id IS NOT NULL AND created_at IS NOT NULL
                     AND reviewer_score IS NOT NULL AND NOT isnan(reviewer_score))
        SELECT rule_id, created_day, id FROM d
        QUALIFY row_number() OVER (PARTITION BY rule_id, created_day ORDER BY reviewer_score DESC, created_at DESC, id) <= 3""",
}
