"""The queries over the project's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapidary.functions import fixed, grids, intents, solvers, text
from lapidary.operators import analytics, curation, sequences
from lapidary.operators.joins import split_join
from lapidary.operators.search import mentions
from lapidary.sources.tables import delivered_once, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# Tables without repeated deliveries.


def _puzzles(spark, base):
    return delivered_once(table(spark, base, "puzzles"), "id")


def _finals(spark, base):
    return delivered_once(table(spark, base, "final_records"), "idx")


def _log(spark, base):
    return delivered_once(table(spark, base, "generation_log"), "id")


def _traces(spark, base):
    return delivered_once(table(spark, base, "call_traces"), "trace_id")


def _evals(spark, base):
    return table(spark, base, "eval_records")


# The same in SQL.

P = "p AS (SELECT DISTINCT id, rule_id, title, question, answer, reviewer_score, created_at, metadata FROM puzzles)"
R = "r AS (SELECT DISTINCT * FROM final_records)"
L = "l AS (SELECT DISTINCT * FROM generation_log)"
T = "t AS (SELECT DISTINCT * FROM call_traces)"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{text.WS}+|{text.WS}+$', '', 'g')"


def s_collapse(x: str) -> str:
    return f"regexp_replace({x}, '{text.WS}+', ' ', 'g')"


def s_print(x: str, n: int = 200) -> str:
    return f"sha1(substring({s_strip(x)}, 1, {n}))"


def s_unwrap(x: str) -> str:
    return f"regexp_replace(regexp_replace({s_strip(x)}, '^\\[\\[', ''), '\\]\\]$', '')"


def s_wrapped(x: str) -> str:
    return f"coalesce(starts_with({s_strip(x)}, '[['), false)"


def s_grid(body: str) -> str:
    return f"list_transform(list_filter(string_split({body}, ','), lambda r: {s_strip('r')} <> ''), lambda r: regexp_split_to_array({s_strip('r')}, '{text.WS}+'))"


def s_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{text.WS}+'), lambda t: t <> '')"


def s_bucket(x: str, n: int = 600) -> str:
    return f"CASE WHEN length({x}) < 300 THEN 'short' WHEN length({x}) < {n} THEN 'medium' WHEN {x} IS NOT NULL THEN 'long' END"


def s_head(x: str) -> str:
    return s_strip(f"split_part({x}, ':', 1)")


def s_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def s_category(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN ({s_list(ids)}) THEN '{name}'" for name, ids in fixed.CATEGORIES.items()) + " END"


_RECT = "(len(g) > 0 AND len(list_distinct(list_transform(g, lambda r: len(r)))) = 1)"


def s_answer_error(answer: str = "answer", rule: str = "rule_id", g: str = "g") -> str:
    """The check of an answer by rule; ``g`` is its grid. The texts of the errors are those of the column functions."""
    fmt = f"CASE WHEN NOT {s_wrapped(answer)} THEN 'Missing [[ wrapper' END"
    plain = "list_transform(r, lambda c: regexp_replace(c, '^(-?)0+([0-9])', '\\1\\2'))"
    uneven = f"list_filter(list_transform({g}, lambda r, i: CASE WHEN len(r) <> len({g}) THEN i END), lambda i: i IS NOT NULL)"
    repeated = f"list_filter(list_transform({g}, lambda r, i: CASE WHEN len(list_distinct({plain})) < len(r) THEN i END), lambda i: i IS NOT NULL)"
    digits = f"len(list_filter(flatten({g}), lambda c: NOT regexp_matches(c, '^-*[0-9][-0-9]*$'))) = 0"
    latin = f"CASE WHEN len({g}) = 0 THEN 'Cannot parse grid' WHEN len({uneven}) > 0 THEN 'Row ' || {uneven}[1] || ' has another length' WHEN {digits} AND len({repeated}) > 0 THEN 'Row ' || {repeated}[1] || ' has duplicates' END"
    rect = _RECT if g == "g" else _RECT.replace("(g", f"({g}").replace("len(g)", f"len({g})")
    grid = f"CASE WHEN len({g}) < 2 THEN 'Grid too small' WHEN NOT {rect} THEN 'Uneven rows' END"
    words = f"CASE WHEN {s_strip(s_unwrap(answer))} = '' THEN 'Empty answer' END"
    pairs = f"list_filter(string_split({s_unwrap(answer)}, ','), lambda p: contains(p, '='))"
    key = lambda x: s_strip(f"split_part({x}, '=', 1)")
    value = s_strip("regexp_replace(p, '^[^=]*=', '')")
    last = f"list_filter({pairs}, lambda p, i: NOT list_contains(list_transform(list_slice({pairs}, i + 1, len({pairs})), lambda y: {key('y')}), {key('p')}))"
    vals = f"list_transform(list_filter(list_transform({last}, lambda p: {value}), lambda v: regexp_matches(v, '^[0-9]+$')), lambda v: regexp_replace(v, '^0+([0-9])', '\\1'))"
    mapping = f"CASE WHEN len({pairs}) = 0 THEN 'Cannot parse mapping' WHEN len(list_distinct({vals})) < len({vals}) THEN 'Duplicate digits in mapping' END"
    return f"""CASE WHEN {answer} IS NULL THEN 'Missing [[ wrapper' WHEN {rule} IN ({s_list(fixed.LATIN_RULES)}) THEN {latin}
        WHEN {rule} IN ({s_list(fixed.GRID_RULES)}) THEN {grid} WHEN {rule} IN ({s_list(fixed.WORD_RULES)}) THEN {words}
        WHEN {rule} IN ({s_list(fixed.MAPPING_RULES)}) THEN {mapping} ELSE {fmt} END"""


_CALIBRATION = """SELECT rule_id, count(*) AS n_examples, min(length(question)) AS q_len_min, max(length(question)) AS q_len_max,
    round(avg(length(question)), 4) AS q_len_avg, min(length(answer)) AS a_len_min, max(length(answer)) AS a_len_max FROM eval_records GROUP BY rule_id"""


# Curation.


@query(
    f"""WITH {P}, e AS (SELECT DISTINCT {s_print('question')} AS k FROM eval_records WHERE question IS NOT NULL),
    b AS (SELECT rule_id, min(length(question)) AS least FROM eval_records GROUP BY rule_id),
    x AS (SELECT p.*, {s_grid(s_unwrap('answer'))} AS g, {s_print('question')} AS k FROM p),
    c AS (SELECT x.id, x.rule_id, x.k, x.created_at, (question IS NULL OR answer IS NULL) AS failed, {s_wrapped('answer')} AS wrapped,
        {s_answer_error(rule='x.rule_id')} AS err, (x.k IN (SELECT k FROM e)) AS held, coalesce(least > 0 AND length(question) < least - 200, false) AS easy
        FROM x LEFT JOIN b ON x.rule_id = b.rule_id),
    d AS (SELECT *, list_filter([CASE WHEN failed THEN 'generation_failed' END, CASE WHEN NOT failed AND NOT wrapped THEN 'bad_answer_format' END,
        CASE WHEN NOT failed AND err IS NOT NULL THEN 'structural_invalid: ' || err END, CASE WHEN NOT failed AND held THEN 'duplicate_of_eval' END], lambda v: v IS NOT NULL) AS a,
        CASE WHEN NOT failed AND easy THEN ['difficulty_too_easy'] ELSE [] END AS z FROM c),
    f AS (SELECT k, min(id) AS first FROM d WHERE len(a) = 0 AND len(z) = 0 GROUP BY k)
    SELECT id, d.rule_id, len(a) + len(z) + (CASE WHEN NOT failed AND d.id > first THEN 1 ELSE 0 END) = 0 AS accepted,
        array_to_string(list_concat(list_concat(a, CASE WHEN NOT failed AND d.id > first THEN ['duplicate_of_accepted'] ELSE [] END), z), '; ') AS reasons
    FROM d LEFT JOIN f ON d.k = f.k"""
)
def curation_gate(spark: SparkSession, base: str) -> DataFrame:
    out = curation.gate(_puzzles(spark, base), _evals(spark, base), ["id"])
    return out.select("id", "rule_id", "accepted", F.array_join("reasons", "; ").alias("reasons"))


@query()
def curation_gate_expressions(spark: SparkSession, base: str) -> DataFrame:
    """The gate with answers of the expression rules evaluated, which SQL can't."""
    rows = _puzzles(spark, base).withColumn("_expression", solvers.expression_error("answer"))
    error = grids.answer_error("rule_id", "answer", F.col("_expression"))
    return curation.gate(rows, _evals(spark, base), ["id"], error).select("id", "rule_id", "accepted", "reasons")


@query(
    f"""WITH {P}, x AS (SELECT *, {s_grid(s_unwrap('answer'))} AS g FROM p)
    SELECT rule_id, count(*) AS n, count_if({s_wrapped('answer')} AND ({s_answer_error()}) IS NULL) AS n_valid FROM x GROUP BY rule_id"""
)
def structural_gate(spark: SparkSession, base: str) -> DataFrame:
    rows = curation.structural_gate(_puzzles(spark, base))
    return rows.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_valid"))


@query(
    f"""WITH {P}, x AS (SELECT *, {s_grid(s_unwrap('answer'))} AS g FROM p)
    SELECT coalesce({s_answer_error()}, 'none') AS error, count(*) AS n FROM x GROUP BY 1"""
)
def answer_errors(spark: SparkSession, base: str) -> DataFrame:
    return _puzzles(spark, base).groupBy(F.coalesce(grids.answer_error("rule_id", "answer"), F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {P} SELECT id, array_to_string(list_filter([CASE WHEN length(coalesce(question, '')) < 20 THEN 'question too short' END,
    CASE WHEN NOT {s_wrapped("coalesce(answer, '')")} THEN 'no wrapper' END, CASE WHEN length(coalesce(answer, '')) < 6 THEN 'answer too short' END], lambda x: x IS NOT NULL), ',') AS errors FROM p"""
)
def output_format(spark: SparkSession, base: str) -> DataFrame:
    return _puzzles(spark, base).select("id", F.array_join(grids.output_errors("question", "answer"), ",").alias("errors"))


@query(f"WITH {R} SELECT idx FROM r WHERE {s_print('question')} IN (SELECT {s_print('question')} FROM eval_records WHERE question IS NOT NULL)")
def heldout_copies(spark: SparkSession, base: str) -> DataFrame:
    return curation.in_heldout(_finals(spark, base), _evals(spark, base)).select("idx")


@query(f"WITH {R} SELECT rule_id, count(*) AS n FROM r WHERE question IS NULL OR {s_print('question')} NOT IN (SELECT {s_print('question')} FROM eval_records WHERE question IS NOT NULL) GROUP BY rule_id")
def heldout_free(spark: SparkSession, base: str) -> DataFrame:
    return curation.not_in_heldout(_finals(spark, base), _evals(spark, base)).groupBy("rule_id").agg(F.count("*").alias("n"))


@query(f"WITH {P} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY {s_print('question')} ORDER BY id) AS n FROM p WHERE question IS NOT NULL) WHERE n = 1 UNION ALL SELECT id FROM p WHERE question IS NULL")
def first_questions(spark: SparkSession, base: str) -> DataFrame:
    return curation.first_of_each(_puzzles(spark, base), text.fingerprint("question"), ["id"]).select("id")


def s_key(x: str) -> str:
    inner = s_strip(f"lower(substring({x}, 1, 200))")
    return f"regexp_replace({s_collapse(inner)}, '[^\\p{{L}}\\p{{N}}_ ]', '', 'g')"


@query(
    f"""WITH {P}, k AS (SELECT id, {s_key('question')} AS k FROM p), e AS (SELECT DISTINCT {s_key('question')} AS k FROM eval_records),
    f AS (SELECT k, min(id) AS first FROM k WHERE k IS NOT NULL GROUP BY k)
    SELECT id, CASE WHEN k.k IN (SELECT k FROM e WHERE k IS NOT NULL) THEN 'heldout' WHEN id > first THEN 'existing' ELSE 'new' END AS status FROM k LEFT JOIN f ON k.k = f.k"""
)
def duplicate_status(spark: SparkSession, base: str) -> DataFrame:
    rows = curation.with_first(_puzzles(spark, base).select("id", text.normal_key("question").alias("k")), F.col("k"), ["id"])
    keys = _evals(spark, base).select(text.normal_key("question").alias("k")).where("k is not null").distinct().withColumn("held", F.lit(True))
    return rows.join(keys, "k", "left").select("id", F.when(F.col("held"), "heldout").when(~F.col("is_first"), "existing").otherwise("new").alias("status"))


@query(
    f"""WITH {R}, e AS (SELECT DISTINCT {s_print('question')} AS k FROM eval_records WHERE question IS NOT NULL),
    x AS (SELECT *, {s_print('question')} AS k FROM r), f AS (SELECT k, min(idx) AS first FROM x WHERE k IS NOT NULL GROUP BY k)
    SELECT rule_id, count(*) AS n, count_if({s_wrapped('answer')}) AS n_format, count_if(x.k IS NULL OR x.k NOT IN (SELECT k FROM e)) AS n_no_eval_dup,
    count_if(x.k IS NULL OR idx = first) AS n_no_intra_dup, count_if(coalesce(metadata.crosscheck_ok, false)) AS n_crosscheck
    FROM x LEFT JOIN f ON x.k = f.k GROUP BY rule_id"""
)
def output_verification(spark: SparkSession, base: str) -> DataFrame:
    return curation.verification(_finals(spark, base), _evals(spark, base), ["idx"], F.col("metadata.crosscheck_ok"))


@query(_CALIBRATION)
def calibrate_targets(spark: SparkSession, base: str) -> DataFrame:
    return curation.calibration(_evals(spark, base))


@query(
    f"""WITH c AS ({_CALIBRATION}) SELECT e.rule_id, first(title ORDER BY item_id) AS title, first(tag ORDER BY item_id) AS tag, sha1(first(rule_content ORDER BY item_id)) AS content,
    array_to_string(list(length(question) ORDER BY item_id), ',') AS lengths, any_value(q_len_min) AS q_len_min, any_value(q_len_max) AS q_len_max
    FROM eval_records e JOIN c ON e.rule_id = c.rule_id GROUP BY e.rule_id"""
)
def rule_index(spark: SparkSession, base: str) -> DataFrame:
    lengths = F.array_join(F.transform("examples", lambda e: F.length(e["question"]).cast("string")), ",")
    return curation.rule_index(_evals(spark, base)).select("rule_id", "title", "tag", F.sha1("rule_content").alias("content"), lengths.alias("lengths"), "q_len_min", "q_len_max")


@query("SELECT rule_id, min(title) AS title, count(*) AS n_examples FROM eval_records GROUP BY rule_id ORDER BY CAST(rule_id AS INT)")
def rule_list(spark: SparkSession, base: str) -> DataFrame:
    return _evals(spark, base).groupBy("rule_id").agg(F.min("title").alias("title"), F.count("*").alias("n_examples")).orderBy(F.col("rule_id").cast("int"))


@query("SELECT '10' AS rule_id, title, tag, (SELECT min(length(question)) FROM eval_records WHERE rule_id = '10') AS q_len_min, (SELECT max(length(question)) FROM eval_records WHERE rule_id = '10') AS q_len_max, substring(question, 1, 300) AS question, substring(answer, 1, 100) AS answer, CAST(NULL AS VARCHAR) AS error FROM eval_records WHERE rule_id = '10' ORDER BY item_id LIMIT 1")
def rule_inspect(spark: SparkSession, base: str) -> DataFrame:
    return curation.inspected(_evals(spark, base), "10")


@query(f"WITH {R} SELECT 'syn-' || rule_id || '-' || row_number() OVER (PARTITION BY rule_id ORDER BY idx) AS new_idx, idx AS old_idx FROM r WHERE coalesce(metadata.structural_ok, false) AND rule_id IS NOT NULL")
def accepted_numbering(spark: SparkSession, base: str) -> DataFrame:
    rows = _finals(spark, base).where("metadata.structural_ok and rule_id is not null").select("rule_id", F.col("idx").alias("old_idx"))
    return curation.numbered(rows, ["old_idx"]).select(F.col("idx").alias("new_idx"), "old_idx")


@query(f"WITH {P}, {R} SELECT rule_id, count(*) AS n FROM (SELECT rule_id, {s_print('question')} AS k FROM p WHERE question IS NOT NULL UNION SELECT rule_id, {s_print('question')} FROM r WHERE question IS NOT NULL) GROUP BY rule_id")
def union_of_prints(spark: SparkSession, base: str) -> DataFrame:
    sides = [t.where("question is not null").select("rule_id", text.fingerprint("question").alias("k")) for t in (_puzzles(spark, base), _finals(spark, base))]
    return sides[0].union(sides[1]).distinct().groupBy("rule_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {P}, {R}, u AS (SELECT id, rule_id, question, answer, 0 AS src FROM p UNION ALL SELECT idx, rule_id, question, answer, 1 FROM r),
    k AS (SELECT substring(md5(coalesce(question, '') || coalesce(answer, '')), 1, 12) AS k, src, id, rule_id FROM u)
    SELECT k AS key, arg_max(id, src || id) AS id, arg_max(rule_id, src || id) AS rule_id FROM k GROUP BY k"""
)
def upsert_records(spark: SparkSession, base: str) -> DataFrame:
    p = _puzzles(spark, base).select(text.record_id("question", "answer").alias("key"), "id", "rule_id")
    r = _finals(spark, base).select(text.record_id("question", "answer").alias("key"), F.col("idx").alias("id"), "rule_id")
    return curation.upserted(p, r, ["key"], ["id"])


# Scalar functions over whole tables.


@query(
    f"""WITH {P}, c AS (SELECT id, {s_unwrap('answer')} AS body FROM p) SELECT id, {s_print('question')} AS print,
    sha1('LLM:' || rule_id || ':' || substring(sha1(substring({s_strip('question')}, 1, 100)), 1, 8)) AS eval_key,
    'ex:' || substring(md5(substring(question, 1, 100)), 1, 8) AS example, substring(md5(coalesce(question, '') || coalesce(answer, '')), 1, 12) AS made FROM p"""
)
def fingerprints(spark: SparkSession, base: str) -> DataFrame:
    return _puzzles(spark, base).select("id", text.fingerprint("question").alias("print"), text.eval_key("rule_id", "question").alias("eval_key"), text.example_key("question").alias("example"), text.record_id("question", "answer").alias("made"))


@query(f"WITH {P} SELECT {s_bucket('question')} AS bucket, {s_bucket('question', 601)} AS batch_bucket, count(*) AS n FROM p GROUP BY 1, 2")
def difficulty_buckets(spark: SparkSession, base: str) -> DataFrame:
    return _puzzles(spark, base).groupBy(text.bucket("question").alias("bucket"), text.batch_bucket("question").alias("batch_bucket")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {P} SELECT id, length(question) AS q_len, len(list_filter({s_tokens('question')}, lambda t: t = 'X')) > 3 AS has_grid,
    len(list_filter(regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_matches(t, '^[0-9]+$'))) AS n_numbers,
    len(list_filter({s_tokens('question')}, lambda t: regexp_matches(t, '^\\p{{L}}\\p{{L}}+$'))) AS n_words, {s_bucket('question')} AS bucket FROM p"""
)
def difficulty_metrics(spark: SparkSession, base: str) -> DataFrame:
    m = text.measures("question")
    return _puzzles(spark, base).select("id", m.alias("m")).select("id", "m.q_len", "m.has_grid", "m.n_numbers", "m.n_words", "m.bucket")


@query(
    f"""WITH {P} SELECT array_to_string(list_slice({s_tokens('lower(question)')}, 1, 5), ' ') AS topic, substring(array_to_string(list_slice({s_tokens('lower(question)')}, 1, 3), ' '), 1, 60) AS short, count(*) AS n
    FROM p GROUP BY 1, 2"""
)
def topic_keys(spark: SparkSession, base: str) -> DataFrame:
    return _puzzles(spark, base).groupBy(text.topic("question").alias("topic"), text.topic("question", 3, 60).alias("short")).agg(F.count("*").alias("n"))


@query(f"WITH {T} SELECT trace_id, length(coalesce(prompt_system, '')) // 4 + length(coalesce(prompt_user, '')) // 4 + length(coalesce(response_raw, '')) // 4 AS tokens, substring(md5(coalesce(prompt_user, '') || coalesce(response_raw, '')), 1, 8) AS hash FROM t")
def token_estimate(spark: SparkSession, base: str) -> DataFrame:
    return _traces(spark, base).select("trace_id", text.token_estimate("prompt_system", "prompt_user", "response_raw").alias("tokens"), text.trace_hash("prompt_user", "response_raw").alias("hash"))


def s_plain(x: str) -> str:
    body = f"regexp_replace({s_unwrap(x)}, '[,\\n]', ' ', 'g')"
    return f"lower({s_strip(s_collapse(body))})"


@query(
    f"""WITH {P}, k AS (SELECT id, answer, regexp_replace(lower(question), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS k FROM p WHERE question IS NOT NULL),
    f AS (SELECT k, min(id) AS first_id, min_by(coalesce(answer, ''), id) AS b FROM k GROUP BY k)
    SELECT id, first_id, (coalesce(answer, '') <> '' AND b <> '' AND coalesce({s_plain('answer')} = {s_plain('b')}, false)) AS same FROM k JOIN f USING (k) WHERE id <> first_id"""
)
def answers_compared(spark: SparkSession, base: str) -> DataFrame:
    """Answers of puzzles whose question recurs in another look, against that of the first such puzzle."""
    key = F.regexp_replace(F.lower("question"), r"[^\p{L}\p{N}]+", "")
    p = _puzzles(spark, base).where("question is not null").select("id", "answer", key.alias("k"))
    first = p.groupBy("k").agg(F.min("id").alias("first_id"), F.min_by(F.coalesce("answer", F.lit("")), "id").alias("b"))
    return split_join(p, first, ["k"], "inner").where("id <> first_id").select("id", "first_id", text.answers_match("answer", "b").alias("same"))


@query(
    f"""WITH {P}, b AS (SELECT id, {s_strip('answer')} AS raw FROM p WHERE answer IS NOT NULL),
    g AS (SELECT id, raw, {s_grid("CASE WHEN starts_with(raw, '[[') AND ends_with(raw, ']]') AND length(raw) >= 4 THEN substring(raw, 3, length(raw) - 4) ELSE raw END")} AS g FROM b)
    SELECT id, array_to_string(list_transform(g, lambda r: array_to_string(r, '')), '|') AS compact, raw AS bare, CAST(to_json(g) AS VARCHAR) AS as_json FROM g"""
)
def format_converted(spark: SparkSession, base: str) -> DataFrame:
    rows = _puzzles(spark, base).where("answer is not null")
    return rows.select("id", text.converted("answer", "compact_grid").alias("compact"), text.converted("answer", "bare").alias("bare"), text.converted("answer", "json_list").alias("as_json"))


@query()
def format_expanded(spark: SparkSession, base: str) -> DataFrame:
    return _puzzles(spark, base).where("answer is not null").select("id", text.converted("answer", "expanded_grid").alias("expanded"))


@query(f"WITH {T} SELECT trace_id, CASE WHEN regexp_extract(response_raw, '(?s)\\[\\[(.+?)\\]\\]', 1) <> '' THEN '[[' || regexp_extract(response_raw, '(?s)\\[\\[(.+?)\\]\\]', 1) || ']]' ELSE {s_strip('response_raw')} END AS span FROM t WHERE agent_role = 'solver'")
def first_spans(spark: SparkSession, base: str) -> DataFrame:
    return _traces(spark, base).where("agent_role = 'solver'").select("trace_id", text.first_span("response_raw").alias("span"))


@query()
def parsed_outputs(spark: SparkSession, base: str) -> DataFrame:
    """Question and answer of every generator output; the cascade of ways to read it is tested on fixtures."""
    return _traces(spark, base).where("agent_role = 'generator'").select("trace_id", text.parsed_output("response_raw", True).alias("o")).select("trace_id", "o.question", "o.answer")


@query(
    f"""WITH {T}, v AS (SELECT trace_id, response_raw AS raw, try_cast(response_raw AS JSON) AS j FROM t WHERE agent_role = 'reviewer')
    SELECT trace_id, CASE WHEN regexp_matches({s_strip('raw')}, '(?s)^\\{{.*\\}}$') AND j->>'verdict' IS NOT NULL THEN j->>'verdict' ELSE 'UNCLEAR' END AS verdict,
    CASE WHEN regexp_matches({s_strip('raw')}, '(?s)^\\{{.*\\}}$') AND j->>'verdict' IS NOT NULL THEN CAST(j->>'score' AS DOUBLE) ELSE 5.0 END AS score FROM v"""
)
def verdicts(spark: SparkSession, base: str) -> DataFrame:
    v = text.verdict("response_raw")
    return _traces(spark, base).where("agent_role = 'reviewer'").select("trace_id", v.alias("v")).select("trace_id", "v.verdict", "v.score")


# Grids.


@query(
    f"""WITH {P}, x AS (SELECT id, {s_grid(s_unwrap('answer'))} AS g FROM p WHERE answer IS NOT NULL)
    SELECT id, len(g) AS n_rows, CASE WHEN len(g) > 0 THEN len(g[1]) ELSE 0 END AS n_columns, {_RECT} AS rectangular,
    len(list_filter(flatten(g), lambda c: NOT regexp_matches(c, '^-*[0-9]+$'))) = 0 AS digits FROM x"""
)
def grid_shapes(spark: SparkSession, base: str) -> DataFrame:
    g = _puzzles(spark, base).where("answer is not null").select("id", grids.grid("answer").alias("g"))
    return g.select("id", grids.shape(F.col("g")).alias("s"), grids.rectangular(F.col("g")).alias("rectangular"), grids.all_digits(F.col("g")).alias("digits")).select("id", F.col("s.rows").alias("n_rows"), F.col("s.columns").alias("n_columns"), "rectangular", "digits")


def _s_symmetries(g: str) -> str:
    ser = lambda x: f"array_to_string(list_transform({x}, lambda r: array_to_string(r, ' ')), ',')"
    up = f"list_reverse({g})"
    across = f"list_transform({g}, lambda r: list_reverse(r))"
    both = f"list_transform(list_reverse({g}), lambda r: list_reverse(r))"
    turned = lambda x: f"list_transform(range(1, len({g}[1]) + 1), lambda j: list_transform({x}, lambda r: r[j]))"
    return "[" + ", ".join(ser(x) for x in (g, up, across, both, turned(g), turned(up), turned(across), turned(both))) + "]"


@query(
    f"""WITH {P}, x AS (SELECT id, {s_grid(s_unwrap('answer'))} AS g FROM p WHERE answer IS NOT NULL), q AS (SELECT * FROM x WHERE {_RECT} AND len(g) = len(g[1]))
    SELECT id, sha1(list_min({_s_symmetries('g')})) AS canon FROM q"""
)
def canonical_grids(spark: SparkSession, base: str) -> DataFrame:
    g = _puzzles(spark, base).where("answer is not null").select("id", grids.grid("answer").alias("g")).where(grids.rectangular(F.col("g")) & (F.size("g") == F.size(F.get("g", F.lit(0)))))
    return g.select("id", F.sha1(grids.canonical(F.col("g"))).alias("canon"))


@query(
    f"""WITH {P}, x AS (SELECT id, {s_grid(s_unwrap('answer'))} AS g FROM p WHERE rule_id IN ({s_list(fixed.LATIN_RULES)}) AND answer IS NOT NULL),
    q AS (SELECT id, g, len(list_filter(flatten(g), lambda c: NOT regexp_matches(c, '^-*[0-9]+$'))) = 0 AS digits, len(list_filter(g, lambda r: len(r) <> len(g))) = 0 AS square FROM x)
    SELECT id, CASE WHEN len(g) = 0 THEN 'no rows' WHEN NOT digits THEN 'not numeric' WHEN NOT square THEN 'not square'
      ELSE array_to_string(list_concat(
        list_filter(list_transform(g, lambda r, i: CASE WHEN list_sort(list_distinct(list_transform(r, lambda c: TRY_CAST(c AS INT)))) <> range(1, len(g) + 1) THEN 'row ' || i END), lambda v: v IS NOT NULL),
        list_filter(list_transform(range(1, len(g) + 1), lambda j: CASE WHEN list_sort(list_distinct(list_transform(g, lambda r: TRY_CAST(r[j] AS INT)))) <> range(1, len(g) + 1) THEN 'column ' || j END), lambda v: v IS NOT NULL)), ',') END AS errors FROM q"""
)
def latin_squares(spark: SparkSession, base: str) -> DataFrame:
    rows = _puzzles(spark, base).where(F.col("rule_id").isin(fixed.LATIN_RULES) & F.col("answer").isNotNull())
    return rows.select("id", F.array_join(grids.full_check("answer", "latin"), ",").alias("errors"))


@query()
def sudoku_checks(spark: SparkSession, base: str) -> DataFrame:
    rows = _puzzles(spark, base).where("rule_id = '15' and answer is not null")
    return rows.select("id", F.array_join(grids.full_check("answer", "sudoku"), ",").alias("errors"))


@query(
    f"""WITH {P}, x AS (SELECT id, {s_grid(s_unwrap('answer'))} AS g FROM p WHERE answer IS NOT NULL),
    i AS (SELECT id, unnest(g) AS r, generate_subscripts(g, 1) AS n FROM x WHERE len(list_filter(flatten(g), lambda c: NOT regexp_matches(c, '^[0-9]{{1,9}}$'))) = 0),
    v AS (SELECT id, n, list_transform(r, lambda c: CAST(c AS INT)) AS r FROM i)
    SELECT id, n AS line, CAST(len(list_filter(r, lambda c, k: k = 1 OR c > list_max(list_slice(r, 1, k - 1)))) AS INT) AS seen FROM v"""
)
def visible_counts(spark: SparkSession, base: str) -> DataFrame:
    g = _puzzles(spark, base).where("answer is not null").select("id", grids.grid("answer").alias("g")).where(F.forall(F.flatten("g"), lambda c: c.rlike("^[0-9]{1,9}$")))
    lines = g.select("id", F.posexplode("g").alias("line", "r"))
    return lines.select("id", (F.col("line") + 1).cast("bigint").alias("line"), grids.visible(F.transform("r", lambda c: c.cast("int"))).alias("seen"))


@query(
    r"""WITH p AS (SELECT DISTINCT id, question FROM puzzles WHERE question IS NOT NULL),
    b AS (SELECT id, regexp_extract(question, 'letter block ([A-Z]+(?: [A-Z]+)+)', 1) AS block, regexp_extract(question, 'Circle ([a-z]+)', 1) AS w FROM p),
    g AS (SELECT id, string_split(block, ' ') AS rows, upper(w) AS w FROM b WHERE block <> '' AND w <> ''),
    c AS (SELECT id, w, r, c, rows FROM g, generate_series(1, 12) AS a(r), generate_series(1, 20) AS d(c) WHERE r <= len(rows) AND c <= length(rows[r])),
    s AS (SELECT c.*, dr, dc, k FROM c, (VALUES ('NW', -1, -1, 1), ('N', -1, 0, 2), ('NE', -1, 1, 3), ('W', 0, -1, 4), ('E', 0, 1, 5), ('SW', 1, -1, 6), ('S', 1, 0, 7), ('SE', 1, 1, 8)) AS v(name, dr, dc, k)),
    m AS (SELECT id, w, r, c, k FROM s WHERE len(list_filter(range(0, length(w)), lambda i: r + dr * i BETWEEN 1 AND len(rows) AND c + dc * i BETWEEN 1 AND length(rows[CAST(r + dr * i AS INT)]) AND substring(rows[CAST(r + dr * i AS INT)], CAST(c + dc * i AS INT), 1) = substring(w, CAST(i AS INT) + 1, 1))) = length(w))
    SELECT g.id, lower(g.w) AS word, min(m.r * 10000 + m.c * 10 + m.k) AS place FROM g LEFT JOIN m ON g.id = m.id GROUP BY ALL"""
)
def word_search(spark: SparkSession, base: str) -> DataFrame:
    """The first circled word of each letter block as row * 10000 + column * 10 + direction (1 to 8), or null; from cells, directions and letters as rows of one array expression."""
    q = _puzzles(spark, base).where("question is not null")
    q = q.select("id", F.regexp_extract("question", "letter block ([A-Z]+(?: [A-Z]+)+)", 1).alias("block"), F.regexp_extract("question", "Circle ([a-z]+)", 1).alias("w"))
    q = q.where("block <> '' and w <> ''").select("id", F.split("block", " ").alias("rows"), F.upper("w").alias("u"), F.col("w").alias("word"))
    cells = q.select("id", "word", "u", "rows", F.posexplode("rows").alias("r", "line"))
    cells = cells.select("id", "word", "u", "rows", "r", F.explode(F.sequence(F.lit(0), F.length("line") - 1)).alias("c"))
    moves = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(k + 1).alias("k")) for k, (_, dr, dc) in enumerate(solvers.DIRECTIONS)])

    def letters(m):
        at = lambda i: F.substring(F.get("rows", F.col("r") + m["dr"] * i), F.col("c") + m["dc"] * i + 1, F.lit(1))
        inside = lambda i: (F.col("c") + m["dc"] * i >= 0) & F.coalesce(at(i) == F.substring("u", i + 1, F.lit(1)), F.lit(False))
        return F.forall(F.sequence(F.lit(0), F.length("u") - 1), inside)

    hits = cells.where(F.substring(F.get("rows", F.col("r")), F.col("c") + 1, F.lit(1)) == F.substring("u", F.lit(1), F.lit(1))).select("id", "r", "c", F.explode(F.filter(moves, letters)).alias("m"))
    first = hits.groupBy("id").agg(F.min((F.col("r") + 1) * 10000 + (F.col("c") + 1) * 10 + F.col("m.k")).alias("place"))
    return q.select("id", "word").join(first, "id", "left").select("id", "word", F.col("place").cast("bigint").alias("place"))


# Run analytics.

_HEADS = f"SELECT id, {s_head('e')} AS reason FROM (SELECT id, unnest(errors) AS e FROM l)"


@query(f"WITH {L}, h AS ({_HEADS}) SELECT reason, count(*) AS n FROM h GROUP BY reason ORDER BY n DESC, min(id), reason LIMIT 10")
def rejection_topk(spark: SparkSession, base: str) -> DataFrame:
    return analytics.top_reasons(_log(spark, base), "errors", "id", 10)


@query(f"WITH {L}, h AS (SELECT rule_id, id, {s_head('e')} AS reason FROM (SELECT rule_id, id, unnest(errors) AS e FROM l)), c AS (SELECT rule_id, reason, count(*) AS n, min(id) AS f FROM h GROUP BY ALL) SELECT rule_id, reason, n FROM c QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, f, reason) <= 5")
def rejection_topk_by_rule(spark: SparkSession, base: str) -> DataFrame:
    counted = analytics.reasons(_log(spark, base), "errors", "id", ["rule_id"])
    return sequences.last_rows(counted, ["rule_id"], [F.desc("n"), F.col("first"), F.col("reason")], 5).select("rule_id", "reason", "n")


_PER_RULE = f"""WITH {R}, {L}, d AS (SELECT unnest(range(1, 26))::VARCHAR AS rule_id),
    a AS (SELECT rule_id, count(*) AS accepted, count_if(coalesce(metadata.structural_ok, true)) AS structural_passed, count_if(coalesce(metadata.crosscheck_ok, false)) AS crosscheck_passed,
        round(avg(coalesce(metadata.reviewer_score, 0)), 3) AS avg_score FROM r GROUP BY rule_id),
    b AS (SELECT rule_id, count(*) AS rejected FROM l WHERE passed = false GROUP BY rule_id)"""


@query(
    f"""{_PER_RULE} SELECT d.rule_id, coalesce(accepted, 0) AS accepted, coalesce(structural_passed, 0) AS structural_passed, coalesce(crosscheck_passed, 0) AS crosscheck_passed, coalesce(avg_score, 0) AS avg_score,
    coalesce(rejected, 0) AS rejected, round(coalesce(accepted, 0) / greatest(coalesce(accepted, 0) + coalesce(rejected, 0), 1), 6) AS accept_rate FROM d LEFT JOIN a ON d.rule_id = a.rule_id LEFT JOIN b ON d.rule_id = b.rule_id"""
)
def per_rule_summary(spark: SparkSession, base: str) -> DataFrame:
    return analytics.per_rule(_accepted(spark, base), _log(spark, base).where(~F.col("passed")))


def _accepted(spark, base):
    return _finals(spark, base).select("rule_id", "metadata.structural_ok", "metadata.crosscheck_ok", "metadata.reviewer_score")


@query(
    f"""WITH {R}, {L}, a AS (SELECT count(*) AS accepted, count_if(coalesce(metadata.structural_ok, true)) AS structural_passed, count_if(coalesce(metadata.crosscheck_ok, false)) AS crosscheck_passed FROM r),
    b AS (SELECT count(*) AS rejected, coalesce(sum(len(list_filter(coalesce(errors, []), lambda e: starts_with(e, 'duplicate')))), 0)::BIGINT AS duplicates FROM l WHERE passed = false),
    t AS (SELECT *, 75::BIGINT AS requested, accepted + rejected AS attempts, 3600.0::DOUBLE AS elapsed FROM a, b),
    s AS (SELECT *, accepted / greatest(requested, 1) AS s1, structural_passed / greatest(attempts, 1) AS s2, crosscheck_passed / greatest(accepted, 1) AS s3,
        greatest(0.0, 1 - duplicates / greatest(attempts, 1)) AS s4, greatest(0.0, least(1.0, 1 - elapsed / greatest(requested, 1) / 120.0)) AS s5 FROM t)
    SELECT accepted, structural_passed, crosscheck_passed, rejected, duplicates, requested, attempts, elapsed, round(s1, 6) AS accept_rate, round(s2, 6) AS structural_rate, round(s3, 6) AS crosscheck_rate,
        round(s4, 6) AS non_duplicate_rate, round(s5, 6) AS latency_rate, round(0.45 * s1 + 0.25 * s2 + 0.15 * s3 + 0.1 * s4 + 0.05 * s5, 6) AS overall FROM s"""
)
def run_totals(spark: SparkSession, base: str) -> DataFrame:
    return analytics.totals(_accepted(spark, base), _log(spark, base).where(~F.col("passed")), 75, 3600.0)


def s_kind(x: str) -> str:
    return f"CASE WHEN {x} IN ({s_list(fixed.ACTIONS)}) THEN {x} WHEN starts_with({x}, 'duplicate') THEN 'duplicate_of_eval' WHEN contains({x}, 'crosscheck') THEN 'crosscheck' ELSE {x} END"


def s_action(x: str) -> str:
    a = fixed.ACTIONS
    return f"CASE WHEN {x} = 'bad_answer_format' THEN '{a['bad_answer_format']}' WHEN {x} = 'structural_invalid' THEN '{a['structural_invalid']}' WHEN starts_with({x}, 'duplicate') THEN '{a['duplicate_of_eval']}' WHEN contains({x}, 'crosscheck') THEN '{a['crosscheck']}' ELSE 'inspect traces and add targeted prompt guardrail' END"


_ADVICE = f"WITH {L}, h AS ({_HEADS}), k AS (SELECT {s_kind('reason')} AS failure, count(*) AS n FROM h GROUP BY 1)"


@query(f"{_ADVICE} SELECT failure, n, {s_action('failure')} AS action FROM k ORDER BY n DESC, failure")
def failure_advice(spark: SparkSession, base: str) -> DataFrame:
    return analytics.advice(_log(spark, base), "errors", "id")


@query(f"WITH {L}, h AS ({_HEADS}), c AS (SELECT reason, count(*) AS n FROM h GROUP BY 1), a AS (SELECT {s_kind('reason')} AS failure, count(*) AS n FROM h GROUP BY 1 ORDER BY n DESC, failure LIMIT 3) SELECT failure, 0 AS part, n FROM a UNION ALL SELECT reason, 1, n FROM c WHERE reason NOT IN (SELECT failure FROM a)")
def failure_ranking(spark: SparkSession, base: str) -> DataFrame:
    log = _log(spark, base)
    return analytics.ranked_failures(analytics.advice(log, "errors", "id").limit(3), analytics.reasons(log, "errors", "id"))


@query(f"WITH {L} SELECT rule_id, count(*) AS total, count_if(coalesce(passed, false)) AS passed, round(count_if(coalesce(passed, false)) / greatest(count(*), 1), 3) AS rate FROM l GROUP BY rule_id")
def rule_stats(spark: SparkSession, base: str) -> DataFrame:
    return analytics.pass_counts(_log(spark, base), ["rule_id"])


@query(f"WITH {L} SELECT session_id, rule_id, count(*) AS total, count_if(coalesce(passed, false)) AS passed, grouping(rule_id)::INT AS whole, round(count_if(coalesce(passed, false)) / greatest(count(*), 1), 3) AS rate FROM l WHERE session_id IS NOT NULL GROUP BY GROUPING SETS ((session_id, rule_id), (session_id))")
def session_stats(spark: SparkSession, base: str) -> DataFrame:
    return analytics.session_rules(_log(spark, base)).withColumn("whole", F.col("whole").cast("int"))


@query(f"WITH {L} SELECT session_id, agent_role, stage, passed, id FROM l WHERE session_id IS NOT NULL AND created_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) = 1")
def session_latest(spark: SparkSession, base: str) -> DataFrame:
    rows = _log(spark, base).where("session_id is not null and created_at is not null").select("session_id", "agent_role", "stage", "passed", "created_at", "id")
    return curation.latest(rows, ["session_id"], ["created_at", "id"]).drop("created_at")


@query(f"WITH {P}, n AS (SELECT rule_id FROM p ORDER BY created_at DESC NULLS LAST, id LIMIT 200) SELECT rule_id, count(*) AS n FROM n GROUP BY rule_id ORDER BY n DESC, rule_id NULLS LAST LIMIT 5")
def generated_topk(spark: SparkSession, base: str) -> DataFrame:
    return analytics.recent_top(_puzzles(spark, base), 200, 5)


@query(f"WITH {P} SELECT count(*) AS n, count_if(rule_id = '10') AS n_rule FROM p")
def puzzle_count(spark: SparkSession, base: str) -> DataFrame:
    return _puzzles(spark, base).agg(F.count("*").alias("n"), F.count_if(F.col("rule_id") == "10").alias("n_rule"))


@query(f"WITH {T}, f AS (SELECT agent_role, len(coalesce(errors, [])) > 0 AS failed FROM t) SELECT agent_role, count(*) AS calls, count_if(failed) AS failures, grouping(agent_role)::INT AS whole, printf('%.1f%%', round((count(*) - count_if(failed)) / greatest(count(*), 1) * 100, 1)) AS pass_rate FROM f GROUP BY ROLLUP (agent_role)")
def trace_summary(spark: SparkSession, base: str) -> DataFrame:
    return analytics.trace_summary(_traces(spark, base)).withColumn("whole", F.col("whole").cast("int"))


def _s_first(x: str, rules, default: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({x}, '{w}')" for w in r[0]) + f" THEN '{r[1]}'" for r in rules) + f" ELSE '{default}' END"


@query(f"WITH {T} SELECT CASE WHEN len(coalesce(errors, [])) = 0 THEN 'none' ELSE {_s_first('lower(errors[1])', fixed.ERROR_CATEGORIES, 'none')} END AS category, error_category AS recorded, count(*) AS n FROM t GROUP BY ALL")
def error_categories(spark: SparkSession, base: str) -> DataFrame:
    return _traces(spark, base).groupBy(text.error_category("errors").alias("category"), F.col("error_category").alias("recorded")).agg(F.count("*").alias("n"))


@query(f"WITH {T}, c AS (SELECT CASE WHEN len(coalesce(errors, [])) = 0 THEN 'none' ELSE {_s_first('lower(errors[1])', fixed.ROOT_CAUSES, 'other')} END AS root_cause, stage FROM t) SELECT root_cause, CASE root_cause " + " ".join(f"WHEN '{n}' THEN '{c}'" for _, n, _, c, _ in fixed.ROOT_CAUSES) + " ELSE 'data_issue' END AS category, CASE root_cause " + " ".join(f"WHEN '{n}' THEN '{s}'" for _, n, s, _, _ in fixed.ROOT_CAUSES) + " ELSE stage END AS stage, count(*) AS n FROM c GROUP BY ALL")
def diagnoses(spark: SparkSession, base: str) -> DataFrame:
    d = _traces(spark, base).select(text.diagnosis("errors", "stage").alias("d"))
    return d.groupBy("d.root_cause", "d.category", "d.stage").agg(F.count("*").alias("n"))


@query(
    f"""WITH {T}, c AS (SELECT rule_id, count(*) AS calls, count_if(len(coalesce(errors, [])) > 0) AS failures FROM t GROUP BY rule_id),
    h AS (SELECT rule_id, trace_id, {s_head('e')} AS reason FROM (SELECT rule_id, trace_id, unnest(errors) AS e FROM t)), k AS (SELECT rule_id, reason, count(*) AS n, min(trace_id) AS f FROM h GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, f, reason) AS i FROM k), z AS (SELECT rule_id, string_agg(reason || '=' || n, ',' ORDER BY i) AS top_errors FROM o WHERE i <= 3 GROUP BY rule_id)
    SELECT c.rule_id, calls, round(failures / calls, 6) AS failure_rate, coalesce(top_errors, '') AS top_errors, CASE WHEN failures / calls > 0.3 THEN 'HIGH' WHEN failures / calls > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
    failures * 2 AS samples, least(failures * 2, 100) AS samples_estimate FROM c LEFT JOIN z ON c.rule_id IS NOT DISTINCT FROM z.rule_id"""
)
def training_report(spark: SparkSession, base: str) -> DataFrame:
    return analytics.training_report(_traces(spark, base))


_VERSIONS = f"WITH {T}, v AS (SELECT model AS version, rule_id, stage, len(coalesce(errors, [])) = 0 AS ok FROM t WHERE rule_id IS NOT NULL)"


def _results(spark, base):
    ok = F.size(F.coalesce("errors", F.array().cast("array<string>"))) == 0
    return _traces(spark, base).where("rule_id is not null").select(F.col("model").alias("version"), "rule_id", "stage", ok.alias("ok"))


@query(f"{_VERSIONS}, g AS (SELECT version, rule_id || '/' || stage AS test, bool_and(ok) AS ok FROM v GROUP BY ALL) SELECT a.test, CASE WHEN a.ok AND NOT b.ok THEN 'regression' WHEN NOT a.ok AND b.ok THEN 'improvement' WHEN b.ok THEN 'both_pass' ELSE 'both_fail' END AS outcome FROM g a JOIN g b ON a.test = b.test WHERE a.version = 'quill-7' AND b.version = 'quill-13'")
def regression_diff(spark: SparkSession, base: str) -> DataFrame:
    tests = _results(spark, base).groupBy("version", F.concat("rule_id", F.lit("/"), "stage").alias("test")).agg(F.every("ok").alias("ok"))
    return analytics.compared(tests, "quill-7", "quill-13")


@query(
    f"""{_VERSIONS}, g AS (SELECT version, rule_id, count(*) AS total, count_if(ok) AS passed FROM v GROUP BY ALL),
    j AS (SELECT a.total AS tp, a.passed AS pp, coalesce(b.total, 0) AS tc, coalesce(b.passed, 0) AS pc FROM g a LEFT JOIN (SELECT * FROM g WHERE version = 'quill-13') b ON a.rule_id = b.rule_id WHERE a.version = 'quill-7'),
    s AS (SELECT round(sum(pc) / greatest(sum(tc), 1) - sum(pp) / greatest(sum(tp), 1), 6) AS gain, round(max(pp / tp - pc / greatest(tc, 1)), 6) AS largest_loss, count_if(pp / tp - pc / greatest(tc, 1) > 0.1) AS rules_lost FROM j)
    SELECT *, concat_ws(',', CASE WHEN gain < 0.05 THEN 'gain too small' END, CASE WHEN rules_lost > 0 THEN 'a rule lost too much' END) AS reasons, NOT (gain < 0.05 OR rules_lost > 0) AS passed FROM s"""
)
def version_gate(spark: SparkSession, base: str) -> DataFrame:
    rules = _results(spark, base).groupBy("version", "rule_id").agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"))
    return analytics.version_gate(rules, "quill-7", "quill-13")


# Sequences.


@query(f"WITH {T} SELECT agent_role, trace_id, error_category, row_number() OVER (PARTITION BY agent_role ORDER BY trace_id DESC) AS position FROM t WHERE len(coalesce(errors, [])) > 0 QUALIFY position <= 5")
def last_failures(spark: SparkSession, base: str) -> DataFrame:
    failed = _traces(spark, base).where(F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0).select("agent_role", "trace_id", "error_category")
    return sequences.last_rows(failed, ["agent_role"], [F.desc("trace_id")], 5)


@query(f"WITH {L} SELECT id, count(*) OVER (PARTITION BY session_id ORDER BY created_at RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM l WHERE session_id IS NOT NULL AND created_at IS NOT NULL")
def sliding_rate(spark: SparkSession, base: str) -> DataFrame:
    return sequences.sliding_counts(_log(spark, base).select("id", "session_id", "created_at"), "session_id", 60).select("id", "in_window")


@query(f"WITH {L}, f AS (SELECT rule_id, min((created_at, id)) AS first FROM l WHERE passed AND created_at IS NOT NULL GROUP BY rule_id) SELECT id, CASE WHEN first < (created_at, id) THEN 'supplement' ELSE 'first' END AS mode FROM l LEFT JOIN f ON l.rule_id = f.rule_id WHERE created_at IS NOT NULL")
def batch_mode(spark: SparkSession, base: str) -> DataFrame:
    rows = _log(spark, base).where("created_at is not null").select("id", "rule_id", "passed", "created_at")
    return sequences.previous_batch(rows, "rule_id", ["created_at", "id"], F.coalesce("passed", F.lit(False))).select("id", "mode")


@query(f"WITH {L}, k AS (SELECT session_id, rule_id, stage, created_at, id FROM l WHERE created_at <= TIMESTAMP '2018-01-20 00:00:00' AND session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) = 1) SELECT session_id, rule_id, stage, id FROM k WHERE created_at + INTERVAL 36000 SECONDS >= TIMESTAMP '2018-01-20 00:00:00'")
def live_keys(spark: SparkSession, base: str) -> DataFrame:
    rows = _log(spark, base).select("session_id", "rule_id", "stage", "created_at", "id")
    return sequences.live_at(rows, "session_id", "created_at", "id", 36000, F.lit("2018-01-20 00:00:00").cast("timestamp_ntz")).select("session_id", "rule_id", "stage", "id")


@query(
    f"""WITH {L}, n AS (SELECT session_id, id, agent_role, row_number() OVER (PARTITION BY session_id ORDER BY id) AS i, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS b, count(*) OVER (PARTITION BY session_id) AS c FROM l WHERE session_id IS NOT NULL),
    t AS (SELECT session_id, min(CASE WHEN b <= 24 AND agent_role = 'generator' THEN i END) AS begin FROM n GROUP BY session_id)
    SELECT n.session_id, id FROM n JOIN t ON n.session_id = t.session_id WHERE c <= 40 OR i = 1 OR (b <= 24 AND i >= coalesce(begin, c - 23))"""
)
def trimmed_history(spark: SparkSession, base: str) -> DataFrame:
    rows = _log(spark, base).where("session_id is not null").select("session_id", "id", "agent_role")
    return sequences.trimmed(rows, "session_id", ["id"], F.col("agent_role") == "generator").select("session_id", "id")


_DELTAS = f"""{L}, u AS (SELECT session_id AS user_id, rule_id, {s_category('rule_id')} AS tag, passed, created_at, id FROM l WHERE session_id IS NOT NULL AND rule_id IS NOT NULL AND passed IS NOT NULL AND created_at IS NOT NULL),
    e AS (SELECT user_id, 'rule' AS kind, rule_id AS key, CASE WHEN passed THEN 2 ELSE -1 END AS d, created_at, id FROM u UNION ALL SELECT user_id, 'tag', tag, CASE WHEN passed THEN 1 ELSE -1 END, created_at, id FROM u WHERE tag IS NOT NULL),
    w AS (SELECT user_id, kind, key, list(d ORDER BY created_at, id) AS ds FROM e GROUP BY ALL),
    v AS (SELECT user_id, kind, key, list_reduce(list_prepend(0::BIGINT, list_transform(ds, lambda x: x::BIGINT)), lambda a, b: greatest(0, a + b)) AS value FROM w)"""


@query(f"WITH {_DELTAS} SELECT * FROM v")
def profile_fold(spark: SparkSession, base: str) -> DataFrame:
    return sequences.profiles(_log(spark, base), "session_id")


@query(
    f"""WITH {_DELTAS}, us AS (SELECT DISTINCT session_id AS user_id FROM l WHERE session_id IS NOT NULL), g AS (SELECT user_id, unnest(range(1, 26))::VARCHAR AS rule_id FROM us),
    c AS (SELECT session_id AS user_id, rule_id, count_if(passed) AS a, count_if(NOT passed) AS r FROM l WHERE session_id IS NOT NULL AND passed IS NOT NULL GROUP BY ALL),
    s AS (SELECT g.user_id, g.rule_id, round(3.0 * coalesce(p.value, 0) + coalesce(q.value, 0) + 1.5 * coalesce(a, 0) - 0.75 * coalesce(r, 0), 3)::DOUBLE AS score,
      CASE WHEN p.value IS NOT NULL THEN 'requested rule' WHEN coalesce(q.value, 0) > 0 THEN 'preferred category' ELSE 'default' END AS reason
      FROM g LEFT JOIN v p ON p.user_id = g.user_id AND p.kind = 'rule' AND p.key = g.rule_id LEFT JOIN v q ON q.user_id = g.user_id AND q.kind = 'tag' AND q.key = {s_category('g.rule_id')} LEFT JOIN c ON c.user_id = g.user_id AND c.rule_id = g.rule_id)
    SELECT user_id, rule_id, score, reason, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, rule_id::INT) AS position FROM s QUALIFY position <= 3"""
)
def recommend_rules(spark: SparkSession, base: str) -> DataFrame:
    return sequences.recommendations(_log(spark, base), "session_id")


@query(
    f"""WITH {L}, o AS (SELECT rule_id, id, coalesce(passed, false) AS ok FROM l WHERE rule_id IS NOT NULL), q AS (SELECT *, sum(ok::INT) OVER (PARTITION BY rule_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS ps FROM o),
    r AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY rule_id, ps ORDER BY id ROWS UNBOUNDED PRECEDING) AS retries FROM q)
    SELECT id, retries::BIGINT AS retries, coalesce(max(retries >= 3) OVER (PARTITION BY rule_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS given_up FROM r"""
)
def retry_runs(spark: SparkSession, base: str) -> DataFrame:
    rows = _log(spark, base).where("rule_id is not null").select("rule_id", "id", "passed")
    return sequences.retry_limit(rows, "rule_id", ["id"], F.col("passed"), 3).select("id", "retries", "given_up")


@query("WITH s AS (SELECT DISTINCT * FROM sessions) SELECT id, CASE WHEN ended_at IS NULL THEN 'open' WHEN ended_at < started_at THEN 'wrong' ELSE 'closed' END AS state, coalesce(total_generated, 0) AS total FROM s")
def session_states(spark: SparkSession, base: str) -> DataFrame:
    state = F.when(F.col("ended_at").isNull(), "open").when(F.col("ended_at") < F.col("started_at"), "wrong").otherwise("closed")
    return table(spark, base, "sessions").distinct().select("id", state.alias("state"), F.coalesce("total_generated", F.lit(0)).alias("total"))


# Text to intents, and searches without SQL.


@query()
def request_intents(spark: SparkSession, base: str) -> DataFrame:
    asked = _traces(spark, base).where("agent_role = 'rewriter' and prompt_user is not null")
    return intents.intents_of(asked, "prompt_user", "trace_id")


@query()
def model_intents(spark: SparkSession, base: str) -> DataFrame:
    told = _traces(spark, base).where("agent_role = 'rewriter' and response_raw is not null")
    return told.select("trace_id", F.posexplode(intents.normalized_intents("response_raw")).alias("position", "i")).select("trace_id", "position", "i.*")


@query(
    "WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), n AS (SELECT DISTINCT rule_id, title FROM eval_records WHERE title IS NOT NULL) SELECT DISTINCT doc_id, rule_id FROM d, n WHERE contains(text, title)"
)
def title_mentions(spark: SparkSession, base: str) -> DataFrame:
    """Documents that hold the title of a rule."""
    titles = _evals(spark, base).where("title is not null").select("rule_id", "title").distinct()
    hits = mentions(table(spark, base, "documents"), "doc_id", "text", titles, "title")
    return hits.join(titles.withColumnRenamed("title", "string"), "string").select(F.col("key").alias("doc_id"), "rule_id").distinct()


@query()
def solve_24(spark: SparkSession, base: str) -> DataFrame:
    """For questions that ask to use up to four numbers: whether 24 can be made of them."""
    numbers = F.transform(F.split(F.regexp_extract("question", "Use ((?:[0-9]+ ){3}[0-9]+) exactly", 1), " "), lambda x: x.cast("int"))
    rows = _puzzles(spark, base).where(F.col("question").rlike("Use (?:[0-9]+ ){3}[0-9]+ exactly")).select("id", numbers.alias("numbers"))
    return rows.select("id", "numbers", (F.size(solvers.solve_24_udf("numbers")) > 0).alias("solvable"))


@query()
def complete_latin(spark: SparkSession, base: str) -> DataFrame:
    """Latin squares completed from the first rows, with values in range, of square answers of two rows or more.

    The solver's limit of steps is the only one of size; a square that reaches it has ``solved`` = false."""
    g = _puzzles(spark, base).where("answer is not null").select("id", grids.grid("answer").alias("g")).where((F.size("g") >= 2) & grids.rectangular(F.col("g")) & grids.all_digits(F.col("g")))
    n = F.size("g")
    clue = F.concat(grids.rendered(F.slice("g", 1, 1)), F.repeat(F.concat(F.lit(","), F.array_join(F.array_repeat(F.lit("0"), n), " ")), n - 1))
    return g.where(F.forall(F.get("g", F.lit(0)), lambda c: c.cast("int").between(1, F.size("g"))) & (F.size("g") == F.size(F.get("g", F.lit(0)))) & (F.size(F.array_distinct(F.get("g", F.lit(0)))) == F.size("g"))).select("id", solvers.latin_udf(clue).alias("s")).select("id", "s.solution", "s.solved")


@query()
def expression_values(spark: SparkSession, base: str) -> DataFrame:
    rows = _puzzles(spark, base).where(F.col("answer").rlike(r"^\[\[[-+*/()0-9 ]+\]\]$"))
    return rows.select("id", solvers.evaluate_udf(text.unwrap("answer")).alias("v")).select("id", "v.result", "v.error")


__all__ = ["ORACLE", "QUERIES", "Window"]
