"""Column functions over questions, answers, model outputs and error texts.

All of them are built from Spark's own expressions, stay in the JVM and return null (or the stated default) for a null
input. White space is that of Unicode, spelt out in ``WS`` so that every regular-expression engine agrees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapidary.functions.fixed import ACTIONS, CATEGORIES, ERROR_CATEGORIES, ROOT_CAUSES

#: White space as a character class.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_VERDICT = "verdict string, generator_correct boolean, answers_match boolean, issues array<string>, score double"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^{WS}+|{WS}+$", "")


def collapse(c: Column | str) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(_col(c), f"{WS}+", " ")


def unwrap(c: Column | str) -> Column:
    """Without white space at the ends, a leading ``[[`` and a trailing ``]]``, each on its own."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"^\[\[", ""), r"\]\]$", "")


def is_wrapped(c: Column | str) -> Column:
    """Whether the value starts with ``[[``; the end isn't looked at."""
    return F.coalesce(F.startswith(strip(c), F.lit("[[")), F.lit(False))


def first_span(c: Column | str) -> Column:
    """The first ``[[...]]`` span, also across lines; else the stripped value."""
    inner = F.regexp_extract(_col(c), r"(?s)\[\[(.+?)\]\]", 1)
    return F.when(inner != "", F.concat(F.lit("[["), inner, F.lit("]]"))).otherwise(strip(c))


def normal_key(c: Column | str, size: int = 200) -> Column:
    """Key of nearly equal questions: the first ``size`` characters in lower case, white space collapsed, then without punctuation."""
    cut = strip(F.lower(F.substring(_col(c), 1, size)))
    return F.regexp_replace(collapse(cut), r"[^\p{L}\p{N}_ ]", "")


def fingerprint(c: Column | str, size: int = 200) -> Column:
    """SHA-1 of the first ``size`` characters of the stripped question."""
    return F.sha1(F.substring(strip(c), 1, size))


def eval_key(rule: Column | str, c: Column | str) -> Column:
    """Key of a held-out question within its rule."""
    return F.sha1(F.concat(F.lit("LLM:"), _col(rule), F.lit(":"), F.substring(F.sha1(F.substring(strip(c), 1, 100)), 1, 8)))


def trace_hash(prompt: Column | str, response: Column | str) -> Column:
    return F.substring(F.md5(F.concat(F.coalesce(_col(prompt), F.lit("")), F.coalesce(_col(response), F.lit("")))), 1, 8)


def example_key(c: Column | str) -> Column:
    return F.concat(F.lit("ex:"), F.substring(F.md5(F.substring(_col(c), 1, 100)), 1, 8))


def record_id(question: Column | str, answer: Column | str, given: Column | str | None = None) -> Column:
    """The given id, or the first 12 hexadecimal digits of the MD5 of question and answer."""
    made = F.substring(F.md5(F.concat(F.coalesce(_col(question), F.lit("")), F.coalesce(_col(answer), F.lit("")))), 1, 12)
    return made if given is None else F.coalesce(F.nullif(_col(given), F.lit("")), made)


def answers_match(a: Column | str, b: Column | str) -> Column:
    """Equality of two answers apart from the wrapper, separators, white space and case; empty ones match nothing."""

    def plain(c):
        return F.lower(strip(collapse(F.regexp_replace(unwrap(c), r"[,\n]", " "))))

    some = (F.coalesce(_col(a), F.lit("")) != "") & (F.coalesce(_col(b), F.lit("")) != "")
    return some & F.coalesce(plain(a) == plain(b), F.lit(False))


def bucket(c: Column | str, long_from: int = 600) -> Column:
    """Difficulty by length: short below 300 characters, medium below ``long_from``, else long."""
    n = F.length(_col(c))
    return F.when(n < 300, "short").when(n < long_from, "medium").when(n.isNotNull(), "long")


def batch_bucket(c: Column | str) -> Column:
    """The same with a question of exactly 600 characters still medium, as batches are counted."""
    return bucket(c, 601)


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), f"{WS}+"), lambda t: t != "")


def measures(c: Column | str) -> Column:
    """Structural difficulty: length, whether there is a grid (more than three X), its width, numbers, words, bucket."""
    return let(F.struct(_col(c).alias("q"), tokens(c).alias("t")), lambda x: _measures(x["q"], x["t"]))


def _measures(q: Column, parts: Column) -> Column:
    marks = F.size(F.filter(parts, lambda t: t == "X"))
    lines = F.filter(F.split(q, "\n"), lambda line: line.rlike(r"^[0-9X\t ]*[0-9X][0-9X\t ]*$"))
    widest = F.coalesce(F.array_max(F.transform(lines, lambda line: F.size(tokens(line)))), F.lit(0))
    words = F.filter(parts, lambda t: t.rlike(r"^\p{L}{2,}$"))
    return F.struct(
        F.length(q).alias("q_len"),
        (marks > 3).alias("has_grid"),
        F.when(marks > 3, widest).otherwise(0).alias("grid_size"),
        F.size(F.filter(F.regexp_extract_all(q, F.lit(r"[\p{L}\p{N}_]+"), 0), lambda t: t.rlike("^[0-9]+$"))).alias("n_numbers"),
        F.size(words).alias("n_words"),
        bucket(q).alias("bucket"),
    )


def topic(c: Column | str, words: int = 5, size: int | None = None) -> Column:
    """The first words of a question in lower case, cut to ``size`` characters."""
    joined = F.array_join(F.slice(tokens(F.lower(_col(c))), 1, words), " ")
    return joined if size is None else F.substring(joined, 1, size)


def token_estimate(*columns: Column | str) -> Column:
    """A quarter of the characters of each text, rounded down, summed."""
    total = F.lit(0)
    for c in columns:
        total = total + F.floor(F.coalesce(F.length(_col(c)), F.lit(0)) / 4)
    return total.cast("bigint")


def reason_head(c: Column | str) -> Column:
    """What stands before the first colon."""
    return strip(F.split_part(_col(c), F.lit(":"), F.lit(1)))


def _first_match(text: Column, rules: list[tuple[tuple[str, ...], str]], default: Column) -> Column:
    out = None
    for words, value in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def error_category(errors: Column | str) -> Column:
    """Category of the first error; ``none`` without errors or where no word fits."""
    e = F.lower(F.get(_col(errors), F.lit(0)))
    return F.when(e.isNull(), "none").otherwise(_first_match(e, ERROR_CATEGORIES, F.lit("none")))


def diagnosis(errors: Column | str, stage: Column | str) -> Column:
    """(stage, root_cause, category, trainable) of a failed call, by the first error; another order of words than in error_category."""
    first = F.get(_col(errors), F.lit(0))
    low = F.lower(first)
    stage = _col(stage)
    kind = F.when(first.isNull(), "none").otherwise(_first_match(low, [(words, name) for words, name, *_ in ROOT_CAUSES], F.lit("other")))
    where, category, trainable = stage, F.lit("data_issue"), F.lit(False)
    for _, name, place, cat, train in ROOT_CAUSES:
        where = F.when(kind == name, place).otherwise(where)
        category = F.when(kind == name, cat).otherwise(category)
        trainable = F.when(kind == name, F.lit(train)).otherwise(trainable)
    return F.struct(where.alias("stage"), kind.alias("root_cause"), category.alias("category"), trainable.alias("trainable"))


def failure_kind(reason: Column | str) -> Column:
    """The head of a rejection reason, kinds of duplicates and of disagreement taken together."""
    head = reason_head(reason)
    known = F.lit(False)
    for name in ACTIONS:
        known = known | (head == name)
    return F.when(known, head).when(F.startswith(head, F.lit("duplicate")), "duplicate_of_eval").when(F.contains(head, F.lit("crosscheck")), "crosscheck").otherwise(head)


def action(kind: Column | str) -> Column:
    """The advice for a kind of failure."""
    k = _col(kind)
    out = F.when(k == "bad_answer_format", ACTIONS["bad_answer_format"]).when(k == "structural_invalid", ACTIONS["structural_invalid"])
    out = out.when(F.startswith(k, F.lit("duplicate")), ACTIONS["duplicate_of_eval"]).when(F.contains(k, F.lit("crosscheck")), ACTIONS["crosscheck"])
    return out.otherwise("inspect traces and add targeted prompt guardrail")


def latency_score(elapsed: Column, requested: Column) -> Column:
    """1 for no time at all down to 0 at two minutes per requested item; 1 for a time that isn't positive."""
    per_item = elapsed / F.greatest(requested, F.lit(1))
    return F.when(elapsed <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - per_item / 120.0)))


def slug(c: Column | str, size: int = 32) -> Column:
    """Letters, digits, dash and underscore in lower case, other runs as one dash, none at the ends."""
    return F.substring(F.lower(F.regexp_replace(F.regexp_replace(_col(c), r"[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", "")), 1, size)


def unescape(c: Column | str) -> Column:
    c = F.replace(_col(c), F.lit('\\"'), F.lit('"'))
    return F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def _both_fields(json: Column) -> Column:
    """(question, answer) of a JSON object that has both, else null."""
    v = F.from_json(json, "question string, answer string", {"mode": "PERMISSIVE"})
    both = F.json_object_keys(F.when(F.get_json_object(json, "$").isNotNull() & strip(json).rlike(r"(?s)^\{.*\}$"), json))
    has = F.array_contains(both, "question") & F.array_contains(both, "answer")
    return F.when(F.coalesce(has, F.lit(False)), F.struct(v["question"].alias("question"), v["answer"].alias("answer")))


def parsed_output(c: Column | str, span_fallback: bool = False) -> Column:
    """(question, answer) of a model's output: a fenced object, the raw object, fields by pattern, and with
    ``span_fallback`` what stands before a ``[[...]]`` span. Null if nothing fits. A planning block is left out first.
    """
    raw = strip(c)
    clean = F.regexp_replace(raw, r"(?s)<planning>.*?</planning>", "")
    fenced = F.regexp_extract(clean, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    field = r'(?s)"%s"\s*:\s*"(.*?)"(?:\s*[,}])'
    q, a = F.regexp_extract(raw, field % "question", 1), F.regexp_extract(raw, field % "answer", 1)
    matched = raw.rlike(field % "question") & raw.rlike(field % "answer")
    by_field = F.when(matched, F.struct(unescape(q).alias("question"), unescape(a).alias("answer")))
    options = [_both_fields(fenced), _both_fields(clean), by_field]
    if span_fallback:
        inner = F.regexp_extract(raw, r"(?s)\[\[(.+?)\]\]", 1)
        before = strip(F.regexp_extract(raw, r"(?s)^(.*?)\[\[.+?\]\]", 1))
        options.append(F.when((inner != "") & (F.length(before) > 20), F.struct(before.alias("question"), F.concat(F.lit("[["), inner, F.lit("]]")).alias("answer"))))
    return F.coalesce(*options)


def verdict(c: Column | str) -> Column:
    """A reviewer's verdict; UNCLEAR with score 5 where the output is no JSON object."""
    raw = _col(c)
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    json = F.when(fenced != "", fenced).otherwise(raw)
    v = F.from_json(json, _VERDICT)
    good = strip(json).rlike(r"(?s)^\{.*\}$") & v["verdict"].isNotNull()
    none = F.struct(
        F.lit("UNCLEAR").alias("verdict"), F.lit(None).cast("boolean").alias("generator_correct"), F.lit(None).cast("boolean").alias("answers_match"),
        F.array(F.lit("Could not parse reviewer output")).alias("issues"), F.lit(5.0).alias("score"),
    )
    return F.when(F.coalesce(good, F.lit(False)), v).otherwise(none)


def sentiment(c: Column | str) -> Column:
    """negative, positive or neutral by key words, negative ones first."""
    t = _col(c)
    rules = [(("不喜欢", "不要", "太难", "太简单", "bad", "worse"), "negative"), (("喜欢", "不错", "更想", "prefer", "good", "great"), "positive")]
    return _first_match(t, rules, F.lit("neutral"))


def tag_kind(c: Column | str) -> Column:
    """A free tag as logic, math, word or spatial; else its first word, cut to 24 characters. Empty for null."""
    t = F.lower(strip(F.coalesce(_col(c), F.lit(""))))
    rules = [(("logic",), "logic"), (("math", "number", "sudoku"), "math"), (("word", "anagram", "letter"), "word"), (("spatial", "grid", "maze"), "spatial")]
    return F.when(t == "", "").otherwise(_first_match(t, rules, F.substring(F.split(t, f"{WS}+")[0], 1, 24)))


def category(rule: Column | str) -> Column:
    """word, math or spatial by rule id; null for an unknown rule."""
    r = _col(rule)
    out = None
    for name, ids in CATEGORIES.items():
        hit = r.isin([str(i) for i in ids])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def mentioned_rules(c: Column | str) -> Column:
    """Ids 1 to 25 named as "rule N", in order of appearance, repeated ones kept."""
    found = F.regexp_extract_all(_col(c), F.lit(r"(?i)(?:rule|规则)\s*([0-9]{1,2})"), 1)
    return F.filter(found, lambda x: x.cast("int").between(1, 25))


def converted(c: Column | str, form: str) -> Column:
    """An answer as compact_grid, expanded_grid, json_list or bare (which keeps the wrapper); the value itself for any other form."""
    from lapidary.functions.grids import grid_of

    raw = strip(c)
    if form == "bare":
        return raw
    wrapped = raw.rlike(r"(?s)^\[\[.*\]\]$") & (F.length(raw) >= 4)
    body = F.when(wrapped, F.substring(raw, F.lit(3), F.greatest(F.length(raw) - 4, F.lit(0)))).otherwise(raw)
    if form == "compact_grid":
        return F.array_join(F.transform(grid_of(body), lambda r: F.array_join(r, "")), "|")
    if form == "json_list":
        return F.to_json(grid_of(body))
    if form == "expanded_grid":
        return let(grid_of(body), _expanded)
    return _col(c)


def _expanded(g: Column) -> Column:
    """Cells set to the right in columns of one width."""
    columns = F.sequence(F.lit(0), F.size(F.get(g, F.lit(0))) - 1)
    width = F.transform(columns, lambda j: F.array_max(F.transform(g, lambda r: F.length(F.get(r, j)))))

    def lines(w):
        cell = lambda x: F.lpad(x["c"], F.greatest(x["w"], F.length(x["c"])), F.lit(" "))
        # Rows longer than the first one end where it ends.
        line = lambda r: F.array_join(F.transform(F.filter(F.arrays_zip(r.alias("c"), w.alias("w")), lambda x: x["c"].isNotNull() & x["w"].isNotNull()), cell), " ")
        return F.array_join(F.transform(g, line), "\n")

    return F.when(F.size(g) > 0, let(width, lines)).otherwise("")
