import pytest
from pyspark.sql import functions as F

from lapidary.functions import text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(("raw", "body"), [(" [[a b]] \n", "a b"), ("[[a", "a"), ("a]]", "a"), ("[[]]", ""), ("　[[x]]\xa0", "x"), (None, None)])
def test_unwrap(spark, raw, body):
    assert one(spark, text.unwrap("a"), a=raw) == body


@pytest.mark.parametrize(("raw", "key"), [("  Hello,\n  World! ", "hello world"), ("难a-b", "难ab"), ("x_y", "x_y"), ("", ""), (None, None)])
def test_normal_key(spark, raw, key):
    assert one(spark, text.normal_key("a"), a=raw) == key


@pytest.mark.parametrize(("a", "b", "same"), [("[[1 2,3 4]]", "1 2\n3 4", True), ("[[A]]", "a", True), ("", "", False), (None, "a", False), ("1 2", "12", False)])
def test_answers_match(spark, a, b, same):
    assert one(spark, text.answers_match("a", "b"), a=a, b=b) is same


@pytest.mark.parametrize(("n", "bucket", "batch"), [(0, "short", "short"), (299, "short", "short"), (300, "medium", "medium"), (599, "medium", "medium"), (600, "long", "medium"), (601, "long", "long")])
def test_bucket(spark, n, bucket, batch):
    q = "x" * n
    assert one(spark, text.bucket("q"), q=q) == bucket
    assert one(spark, text.batch_bucket("q"), q=q) == batch


def test_measures(spark):
    m = one(spark, text.measures("q"), q="Fill X X X X now\nX 1 X\n12 X X 3\nrow7 a bc")
    assert (m.q_len, m.has_grid, m.grid_size, m.n_words, m.bucket) == (41, True, 4, 3, "short")
    assert m.n_numbers == 3
    assert one(spark, text.measures("q"), q="").n_words == 0


@pytest.mark.parametrize(
    ("errors", "category", "cause"),
    [
        (["Row 1 has duplicates"], "duplicate", "duplicate question"),
        (["Cannot parse grid"], "parse", "unparseable output"),
        (["Answer must be wrapped in [[...]]"], "none", "other"),
        (["structural_invalid: row 2", "parse"], "structure", "violated constraint"),
        (["crosscheck mismatch"], "crosscheck", "disagreement"),
        ([], "none", "none"),
        (None, "none", "none"),
    ],
)
def test_error_kinds(spark, errors, category, cause):
    df = spark.createDataFrame([(errors, "s")], "e array<string>, s string")
    r = df.select(text.error_category("e").alias("c"), text.diagnosis("e", "s").alias("d")).first()
    assert (r.c, r.d.root_cause) == (category, cause)


def test_parsed_output(spark):
    cases = {
        "fenced": ('<planning>p</planning>\n```json\n{"question": "q1", "answer": "a1"}\n```', ("q1", "a1")),
        "raw": ('{"question": "q2", "answer": "[[1]]", "planning": "x"}', ("q2", "[[1]]")),
        "fields": ('broken {"question": "q \\"3\\"", "answer": "a\\n3", oops', ("q \"3\"", "a\n3")),
        "span": ("A question that is long enough to stand. [[1 2]]", ("A question that is long enough to stand.", "[[1 2]]")),
        "none": ("nothing here", None),
        "empty": ("", None),
        "null": (None, None),
        "one field": ('{"question": "only"}', None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, t string")
    got = {r.k: (r.o.question, r.o.answer) if r.o else None for r in df.select("k", text.parsed_output("t", True).alias("o")).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_verdict(spark):
    good, fenced, bad = '{"verdict": "PASS", "score": 9, "issues": []}', '```json\n{"verdict": "FAIL", "score": 2}\n```', "no json"
    df = spark.createDataFrame([(good,), (fenced,), (bad,), (None,)], "t string")
    rows = [(r.v.verdict, r.v.score) for r in df.select(text.verdict("t").alias("v")).collect()]
    assert rows == [("PASS", 9.0), ("FAIL", 2.0), ("UNCLEAR", 5.0), ("UNCLEAR", 5.0)]


@pytest.mark.parametrize(("form", "out"), [("compact_grid", "ab|cd"), ("json_list", '[["a","b"],["c","d"]]'), ("bare", "[[a b, c d]]"), ("expanded_grid", "a b\nc d"), ("other", " [[a b, c d]]")])
def test_converted(spark, form, out):
    assert one(spark, text.converted("a", form), a=" [[a b, c d]]") == out


def test_expanded_width(spark):
    assert one(spark, text.converted("a", "expanded_grid"), a="[[1 22,333 4]]") == "  1 22\n333  4"


def test_small_functions(spark):
    assert one(spark, text.reason_head("a"), a=" structural : row 1") == "structural"
    assert one(spark, text.slug("a"), a="--Bad answer / format!--") == "bad-answer-format"
    assert one(spark, text.unescape("a"), a='a\\"b\\nc\\td') == 'a"b\nc\td'
    assert one(spark, text.first_span("a"), a="x [[1\n2]] [[3]]") == "[[1\n2]]"
    assert one(spark, text.topic("a"), a=" One two THREE four five six") == "one two three four five"
    assert one(spark, text.tag_kind("a"), a="Logic math") == "logic"
    assert one(spark, text.tag_kind("a"), a=None) == ""
    assert one(spark, text.sentiment("a"), a="不喜欢, good") == "negative"
    assert one(spark, text.mentioned_rules("a"), a="Rule 10, rule 26 and 规则3") == ["10", "3"]
    assert one(spark, text.category("a"), a="24") == "word"
    assert one(spark, text.failure_kind("a"), a="duplicate_in_batch: x") == "duplicate_of_eval"
    assert one(spark, text.action("a"), a="anything").startswith("inspect")


@pytest.mark.parametrize(("elapsed", "requested", "score"), [(60.0, 10, 0.95), (0.0, 1, 1.0), (-5.0, 1, 1.0), (1e9, 1, 0.0), (60.0, 0, 0.5)])
def test_latency_score(spark, elapsed, requested, score):
    r = spark.range(1).select(text.latency_score(F.lit(elapsed), F.lit(requested)).alias("s")).first()
    assert r.s == pytest.approx(score)
