"""Queries of selection and description, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.functions import fixed, grids, intents, text
from lapidary.operators import analytics, selection, sequences
from lapidary.plans.catalog import _DELTAS, L, P, R, T, _evals, _finals, _log, _puzzles, _traces, query, s_bucket, s_head, s_wrapped
from lapidary.sources.tables import table


@query(f"SELECT rule_id, item_id, row_number() OVER (PARTITION BY rule_id ORDER BY CASE WHEN {s_bucket('question')} = 'medium' THEN 0 ELSE 1 END, md5(item_id::VARCHAR)) AS position FROM eval_records WHERE question IS NOT NULL QUALIFY position <= 3")
def few_shot_examples(spark: SparkSession, base: str) -> DataFrame:
    return selection.few_shot(_evals(spark, base), "medium", 3)


@query("SELECT rule_id, item_id, sum(length(question) // 4 + length(answer) // 4) OVER (PARTITION BY rule_id ORDER BY item_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM eval_records QUALIFY used <= 800")
def prompt_budget(spark: SparkSession, base: str) -> DataFrame:
    return selection.within_budget(_evals(spark, base), "rule_id", ["item_id"], text.token_estimate("question", "answer"), 800).select("rule_id", "item_id", "used")


@query("WITH c AS (SELECT rule_id, count(*) AS n FROM eval_records GROUP BY rule_id) SELECT rule_id, array_to_string(list_transform(range(0, n), lambda i: ['short', 'medium', 'long'][i % 3 + 1]), ',') AS plan FROM c")
def difficulty_plan(spark: SparkSession, base: str) -> DataFrame:
    n = _evals(spark, base).groupBy("rule_id").agg(F.count("*").alias("n"))
    return n.select("rule_id", F.array_join(selection.tiled(["short", "medium", "long"], F.col("n")), ",").alias("plan"))


@query("SELECT DISTINCT id FROM sessions WHERE id GLOB 'sess-0000000?'")
def session_keys(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "sessions").where(F.col("id").rlike(selection.glob("sess-0000000?"))).select("id").distinct()


@query(
    f"""WITH {L}, s AS (SELECT DISTINCT id, total_generated FROM sessions), d AS (SELECT session_id AS id, count(*) AS completed, count_if(coalesce(passed, false)) AS passed, count_if(NOT coalesce(passed, true)) AS failed FROM l WHERE session_id IS NOT NULL GROUP BY 1)
    SELECT s.id, coalesce(completed, 0) AS completed, coalesce(passed, 0) AS passed, coalesce(failed, 0) AS failed, round(coalesce(passed, 0) / greatest(coalesce(completed, 0), 1), 3) AS rate, greatest(coalesce(total_generated, 0) - coalesce(completed, 0), 0)::BIGINT AS left FROM s LEFT JOIN d ON s.id = d.id"""
)
def session_progress(spark: SparkSession, base: str) -> DataFrame:
    return selection.progress(_log(spark, base), table(spark, base, "sessions").select("id", "total_generated").distinct())


@query(f"WITH {R} SELECT rule_id, CASE WHEN NOT coalesce(metadata.structural_ok, true) THEN 'fail' WHEN metadata.reviewer_score < 5 THEN 'low' ELSE 'pass' END AS status, count(*) AS n FROM r GROUP BY ALL")
def quality_status(spark: SparkSession, base: str) -> DataFrame:
    rows = _finals(spark, base).select("rule_id", "metadata.structural_ok", "metadata.reviewer_score")
    return selection.quality(rows).groupBy("rule_id", "status").agg(F.count("*").alias("n"))


@query(f"WITH {R} SELECT rule_id, bool_and({s_wrapped('answer')}) AS all_wrapped, count(*) AS n FROM r GROUP BY rule_id")
def outputs_all_wrapped(spark: SparkSession, base: str) -> DataFrame:
    return _finals(spark, base).groupBy("rule_id").agg(F.every(text.is_wrapped("answer")).alias("all_wrapped"), F.count("*").alias("n"))


def _s_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


@query(
    f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN {_s_any('t', ['难一点', '困难', '复杂', 'hard'])} THEN 'hard' WHEN {_s_any('t', ['简单', '容易', '短一点', 'easy'])} THEN 'easy' WHEN {_s_any('t', ['中等', '普通', 'medium'])} THEN 'medium' END AS difficulty,
    {_s_any('t', ['数学', '计算', '24点', 'math'])} AS math, {_s_any('t', ['字谜', '词', '文字', 'word'])} AS word FROM d"""
)
def feedback_levels(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents").where("text is not null").select("doc_id", selection.feedback("text").alias("f"))
    says = lambda k: F.exists("f.changes", lambda x: (x["kind"] == "tag") & (x["key"] == k) & (x["delta"] == 2))
    return d.select("doc_id", "f.difficulty", says("math").alias("math"), says("word").alias("word"))


@query(
    f"""WITH {_DELTAS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY value DESC, key) AS i FROM v),
    x AS (SELECT user_id, string_agg('R' || key || ':' || value, ', ' ORDER BY i) FILTER (WHERE kind = 'rule' AND i <= 5) AS r, string_agg(key || ':' || value, ', ' ORDER BY i) FILTER (WHERE kind = 'tag' AND i <= 5) AS t FROM o GROUP BY user_id)
    SELECT user_id, concat_ws(chr(10), 'user_id=' || user_id, 'preferred_rules=' || r, 'preferred_tags=' || t) AS context FROM x"""
)
def profile_context(spark: SparkSession, base: str) -> DataFrame:
    v = sequences.profiles(_log(spark, base), "session_id")
    # A user has at most one entry for each rule and category.
    entries = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "value"))))
    p = v.groupBy("user_id").agg(entries("rule").alias("rules"), entries("tag").alias("tags"))
    return p.select("user_id", selection.profile_text(F.col("user_id"), F.lit("auto"), F.col("rules"), F.col("tags")).alias("context"))


@query(
    f"""WITH {P}, j AS (SELECT id, question, try_cast(metadata AS JSON) AS m FROM p) SELECT m->>'session_id' AS session_id, {s_bucket('question', 601)} AS bucket, count(*) AS n FROM j WHERE m->>'session_id' IS NOT NULL GROUP BY ALL"""
)
def session_distribution(spark: SparkSession, base: str) -> DataFrame:
    session = F.try_variant_get(F.try_parse_json("metadata"), "$.session_id", "string")
    rows = _puzzles(spark, base).select(session.alias("session_id"), text.batch_bucket("question").alias("bucket")).where("session_id is not null")
    return rows.groupBy("session_id", "bucket").agg(F.count("*").alias("n"))


@query(
    f"""WITH {R}, {L}, {T}, a AS (SELECT count(*) AS accepted, count(DISTINCT rule_id) AS rules FROM r), b AS (SELECT count_if(NOT coalesce(passed, true)) AS rejected FROM l), c AS (SELECT count(*) AS calls, count_if(len(coalesce(errors, [])) > 0) AS failures, sum(tokens_approx)::BIGINT AS tokens FROM t),
    h AS (SELECT {s_head('e')} AS reason, count(*) AS n, min(id) AS f FROM (SELECT id, unnest(errors) AS e FROM l) GROUP BY 1), k AS (SELECT string_agg(reason || '=' || n, ',' ORDER BY n DESC, f, reason) AS top FROM (SELECT * FROM h ORDER BY n DESC, f, reason LIMIT 3))
    SELECT * FROM a, b, c, k"""
)
def run_summary(spark: SparkSession, base: str) -> DataFrame:
    """One row: production, rejections, calls and the three most frequent reasons."""
    log, traces = _log(spark, base), _traces(spark, base)
    a = _finals(spark, base).agg(F.count("*").alias("accepted"), F.count_distinct("rule_id").alias("rules"))
    b = log.agg(F.count_if(~F.coalesce("passed", F.lit(True))).alias("rejected"))
    c = traces.agg(F.count("*").alias("calls"), F.count_if(F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0).alias("failures"), F.sum("tokens_approx").alias("tokens"))
    top = analytics.reasons(log, "errors", "id").orderBy(F.desc("n"), "first", "reason").limit(3)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "reason")))
    k = top.agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["reason"], F.lit("="), (-x["m"]).cast("string"))), ",").alias("top"))
    one = F.lit(True)
    return a.join(b, one).join(c, one).join(k, one)


@query()
def request_jobs(spark: SparkSession, base: str) -> DataFrame:
    asked = _traces(spark, base).where("agent_role = 'rewriter' and prompt_user is not null")
    return selection.jobs(intents.intents_of(asked, "prompt_user", "trace_id"), "trace_id", fixed.RULES)


@query()
def sudoku_candidates(spark: SparkSession, base: str) -> DataFrame:
    """Digits left for the first cell of every answer that reads as 81 cells."""
    rows = _puzzles(spark, base).where("rule_id = '15'").select("id", grids.sudoku_cells("answer").alias("cells")).where("cells is not null")
    return rows.select("id", F.array_join(F.transform(selection.free_digits(F.col("cells"), 0), lambda x: x.cast("string")), "").alias("free"))


@query(f"WITH {T}, f AS (SELECT agent_role, model, count(*) AS calls, sum(latency_ms)::BIGINT AS latency, grouping(model)::INT AS g1, grouping(agent_role)::INT AS g2 FROM t GROUP BY ROLLUP (agent_role, model)) SELECT * FROM f")
def usage_rollup(spark: SparkSession, base: str) -> DataFrame:
    r = _traces(spark, base).rollup("agent_role", "model")
    return r.agg(F.count("*").alias("calls"), F.sum("latency_ms").alias("latency"), F.grouping("model").cast("int").alias("g1"), F.grouping("agent_role").cast("int").alias("g2"))
