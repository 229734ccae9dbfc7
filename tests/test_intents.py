import pytest

from lapidary.functions import intents

PROBES = [
    ("再来两道刚才那种，难一点", "Rule 10 (2 items)", ["GENERATE"], ["10"], "long"),
    ("来点烧脑的数字网格题", "", ["GENERATE"] * 3, ["11", "12", "13"], "long"),
    ("类似数独但不要数独本体，给我三个", "", ["GENERATE"] * 3, ["16", "17", "25"], None),
    ("根据我之前的偏好推荐下一步", "", ["RECOMMEND"], [None], None),
    ("规则10和25都来一道", "", ["GENERATE"] * 2, ["10", "25"], None),
    ("不要数学，来点文字类的题", "", ["GENERATE"] * 3, ["1", "2", "3"], None),
    ("都再补一道", "Rule 10, then Rule 25", ["GENERATE"] * 2, ["10", "25"], None),
    ("像24点那种计算感，但换个形式，来两道", "", ["GENERATE"] * 3, ["9", "11", "12"], None),
    ("不要空间类，想练计算推理", "", ["GENERATE"] * 3, ["7", "15", "17"], None),
    ("give me 2 hard grid logic puzzles, not sudoku", "", ["GENERATE"] * 3, ["11", "12", "13"], "long"),
]


def test_probes(spark):
    df = spark.createDataFrame([(str(i), q, c) for i, (q, c, *_) in enumerate(PROBES)], "k string, q string, c string")
    rows = intents.intents_of(df, "q", "k", "c").orderBy("k", "position").collect()
    for i, (query, _, actions, rules, bucket) in enumerate(PROBES):
        own = [r for r in rows if r.k == str(i)]
        assert [r.action for r in own] == actions, query
        assert [r.rule_id for r in own] == rules, query
        if bucket:
            assert {r.bucket for r in own} == {bucket}, query


@pytest.mark.parametrize(("q", "n"), [("3个", 3), ("两道", 2), ("二十三题", 23), ("十道", 10), ("give me 4", 4), ("each 5", 5), ("nothing", None), ("", None), (None, None)])
def test_count(spark, q, n):
    assert spark.createDataFrame([(q,)], "q string").select(intents.asked_count("q").alias("n")).first().n == n


@pytest.mark.parametrize(("q", "ids"), [("rule 10 and 25", ["10", "25"]), ("sudoku", ["15"]), ("计算数独", ["15", "16"]), ("make 3 puzzles of 12", ["12"]), ("rules 1,2,3", ["1", "2", "3"]), ("30", []), ("", [])])
def test_rule_ids(spark, q, ids):
    assert spark.createDataFrame([(q,)], "q string").select(intents.rule_ids("q").alias("n")).first().n == ids


def test_compound(spark):
    df = spark.createDataFrame([("a", "看规则25然后生成2道数独"), ("b", None), ("c", "")], "k string, q string")
    rows = [(r.k, r.action, r.rule_id, r["count"]) for r in intents.intents_of(df, "q", "k").orderBy("k", "position").collect()]
    assert rows == [("a", "INSPECT_RULE", "25", None), ("a", "GENERATE", "15", 2)]


def test_model_answers(spark):
    good = '{"intents": [{"action": "list"}, {"action": "GENERATE", "params": {"rule_id": "10", "count": 2}}, {"action": "generate_puzzles", "params": {"domain": "math"}}]}'
    df = spark.createDataFrame([(good,), ("broken",), (None,)], "j string")
    rows = [[(i.action, i.rule_id, i["count"]) for i in r.v] for r in df.select(intents.normalized_intents("j").alias("v")).collect()]
    assert rows[0] == [("LIST_RULES", None, None), ("GENERATE", "10", 2), ("GENERATE", "9", 1), ("GENERATE", "10", 1), ("GENERATE", "11", 1)]
    assert rows[1] == rows[2] == [("HELP", None, None)]
