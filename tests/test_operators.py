import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lapidary.operators import analytics, curation, sequences
from lapidary.sources.tables import delivered_once

RECORDS = "id string, rule_id string, question string, answer string"
EVALS = "item_id long, rule_id string, title string, tag string, rule_content string, question string, answer string"
LONG = "A question that is long enough to be taken for a real one, number %d. " * 4


def evals(spark):
    return spark.createDataFrame([(1, "1", "T", "word", "c", LONG % (0, 0, 0, 0), "[[a]]"), (2, "2", "U", None, None, "x" * 900, None), (3, "1", "T", "word", "c", None, "[[b]]")], EVALS)


def test_gate(spark):
    q = LONG % (1, 1, 1, 1)
    rows = [
        ("a", "1", q, "no wrapper"),  # its question isn't taken: the row has another reason
        ("b", "1", q, "[[ok]]"),
        ("c", "1", " " + q, "[[ok]]"),
        ("d", "1", LONG % (0, 0, 0, 0), "[[ok]]"),
        ("e", "2", "y" * 600, "[[ok]]"),
        ("f", "1", None, "[[ok]]"),
        ("g", "1", q + "!", None),
        ("h", None, LONG % (5, 5, 5, 5), "[[ok]]"),
        ("i", "11", LONG % (6, 6, 6, 6), "[[1 2,3]]"),
    ]
    out = {r.id: r.reasons for r in curation.gate(spark.createDataFrame(rows, RECORDS), evals(spark), ["id"]).collect()}
    assert out["a"] == ["bad_answer_format", "structural_invalid: Missing [[ wrapper"]
    assert out["b"] == [] and out["c"] == ["duplicate_of_accepted"] and out["d"] == ["duplicate_of_eval"]
    assert out["e"] == ["difficulty_too_easy"] and out["f"] == out["g"] == ["generation_failed"] and out["h"] == []
    assert out["i"] == ["structural_invalid: Uneven rows"]


def test_gate_keeps_clashing_columns(spark):
    df = spark.createDataFrame([("a", "1", LONG % (1, 1, 1, 1), "[[x]]", 1, 2)], RECORDS + ", n long, k long")
    assert curation.gate(df, evals(spark), ["id"]).columns == [*["rule_id"], *[c for c in df.columns if c != "rule_id"], "reasons", "accepted"] or set(df.columns) < set(curation.gate(df, evals(spark), ["id"]).columns)


def test_empty_tables(spark):
    none = spark.createDataFrame([], RECORDS)
    nothing = spark.createDataFrame([], EVALS)
    assert curation.gate(none, evals(spark), ["id"]).count() == 0
    assert curation.gate(none, nothing, ["id"]).count() == 0
    assert curation.in_heldout(none, nothing).count() == 0 and curation.rule_index(nothing).count() == 0
    assert curation.first_of_each(none, F.col("question"), ["id"]).count() == 0
    acc = spark.createDataFrame([], "rule_id string, structural_ok boolean, crosscheck_ok boolean, reviewer_score int")
    rej = spark.createDataFrame([], "rule_id string, errors array<string>")
    assert analytics.per_rule(acc, rej).where("accepted = 0 and accept_rate = 0").count() == 25
    assert analytics.totals(acc, rej, 0, 0.0).first().overall == pytest.approx(0.15)


def test_heldout_and_first(spark):
    rows = spark.createDataFrame([("a", "1", "q", "x"), ("b", "1", " q ", "x"), ("c", "1", None, "x"), ("d", "1", None, "x"), ("e", "1", "z", "x")], RECORDS)
    held = spark.createDataFrame([(1, "1", "t", "", "", "z", ""), (2, "1", "t", "", "", None, "")], EVALS)
    assert [r.id for r in curation.in_heldout(rows, held).collect()] == ["e"]
    assert sorted(r.id for r in curation.not_in_heldout(rows, held).collect()) == ["a", "b", "c", "d"]
    assert sorted(r.id for r in curation.first_of_each(rows, F.trim("question"), ["id"]).collect()) == ["a", "c", "d", "e"]


def test_score(spark):
    t = spark.createDataFrame([(10, 8, 12, 8, 6, 1, 60.0)], "requested long, accepted long, attempts long, structural_passed long, crosscheck_passed long, duplicates long, elapsed double")
    s = analytics.scored(t).first()
    assert (s.accept_rate, s.structural_rate, s.crosscheck_rate, s.non_duplicate_rate, s.latency_rate, s.overall) == (0.8, 0.666667, 0.75, 0.916667, 0.95, 0.778333)


def test_top_reasons_ties(spark):
    df = spark.createDataFrame([(1, ["b: x", "a"]), (2, ["a: y", "b"]), (3, None), (4, []), (5, ["c"])], "id long, errors array<string>")
    assert [(r.reason, r.n) for r in analytics.top_reasons(df, "errors", "id", 2).collect()] == [("a", 2), ("b", 2)]


def test_version_gate(spark):
    rows = [("p", "10", 10, 8), ("p", "11", 10, 5), ("c", "10", 10, 9), ("c", "11", 10, 7)]
    df = spark.createDataFrame(rows, "version string, rule_id string, total long, passed long")
    good = analytics.version_gate(df, "p", "c").first()
    assert (good.gain, good.largest_loss, good.passed, good.reasons) == (0.15, -0.1, True, "")
    bad = analytics.version_gate(df, "c", "p").first()
    assert not bad.passed and bad.reasons == "gain too small,a rule lost too much"
    gone = analytics.version_gate(df.where("version = 'p' or rule_id = '10'"), "p", "c").first()
    assert gone.rules_lost == 1


def test_compared_and_best(spark):
    df = spark.createDataFrame([("p", "a", True), ("p", "b", False), ("p", "c", False), ("c", "a", False), ("c", "b", True), ("c", "c", False)], "version string, test string, ok boolean")
    assert {r.test: r.outcome for r in analytics.compared(df, "p", "c").collect()} == {"a": "regression", "b": "improvement", "c": "both_fail"}
    s = spark.createDataFrame([(1, 0.5, True), (2, 0.5, True), (3, 0.9, False)], "position int, score double, passed boolean")
    assert analytics.best_candidate(s).first().position == 1


def test_floored_sums(spark):
    rng = random.Random(3)
    start = dt.datetime(2020, 1, 1)
    rows, want = [], {}
    for u in range(6):
        x, n = 0, rng.randrange(0, 60)
        for i in range(n):
            d = rng.choice([2, -1, -3, 1])
            rows.append((f"u{u}", start + dt.timedelta(hours=7 * (i // 2)), i, d))
            x = max(0, x + d)
        if n:
            want[f"u{u}"] = x
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "u string, at timestamp_ntz, id long, d int")
    assert {r.u: r.value for r in sequences.floored_sums(df, ["u"], "at", ["at", "id"], "d").collect()} == want


def test_sliding_counts(spark):
    rng = random.Random(4)
    start = dt.datetime(2020, 1, 1)
    rows = [(i, rng.choice(["a", "b", None]), None if i % 17 == 0 else start + dt.timedelta(seconds=rng.randrange(600))) for i in range(200)]
    got = {r.id: r.in_window for r in sequences.sliding_counts(spark.createDataFrame(rows, "id long, s string, created_at timestamp_ntz"), "s", 60).collect()}
    good = [r for r in rows if r[1] and r[2]]
    assert got == {i: sum(x == s and 0 <= (t - y).total_seconds() <= 60 for _, x, y in good) for i, s, t in good}


def test_trimmed(spark):
    roles = ["system"] + ["user", "assistant", "tool"] * 20
    rows = [("long", i, r) for i, r in enumerate(roles)] + [("short", i, "user") for i in range(5)] + [("plain", i, "tool") for i in range(50)]
    out = sequences.trimmed(spark.createDataFrame(rows, "c string, i long, role string"), "c", ["i"], F.col("role") == "user")
    got = {}
    for r in out.collect():
        got.setdefault(r.c, set()).add(r.i)
    tail = list(range(61 - 24, 61))
    first = next(i for i in tail if roles[i] == "user")
    assert got["long"] == {0, *range(first, 61)} and got["short"] == set(range(5)) and got["plain"] == {0, *range(26, 50)}


def test_live_modes_retries(spark):
    start = dt.datetime(2020, 1, 1)
    rows = [("a", start, 1, "x"), ("a", start + dt.timedelta(hours=1), 2, "y"), ("b", start, 3, "z"), (None, start, 4, "n"), ("c", None, 5, "n")]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, id long, v string")
    now = F.lit("2020-01-01 01:30:00").cast("timestamp_ntz")
    assert {(r.k, r.v) for r in sequences.live_at(df, "k", "at", "id", 3600, now).collect()} == {("a", "y")}
    log = spark.createDataFrame([("r", 1, False), ("r", 2, True), ("r", 3, False), ("r", 4, None), ("r", 5, False), ("r", 6, True)], "rule string, id long, passed boolean")
    modes = {r.id: r.mode for r in sequences.previous_batch(log, "rule", ["id"], F.coalesce("passed", F.lit(False))).collect()}
    assert modes == {1: "first", 2: "first", 3: "supplement", 4: "supplement", 5: "supplement", 6: "supplement"}
    runs = {r.id: (r.retries, r.given_up) for r in sequences.retry_limit(log, "rule", ["id"], F.col("passed"), 3).collect()}
    assert runs == {1: (1, False), 2: (0, False), 3: (1, False), 4: (2, False), 5: (3, False), 6: (0, True)}


def test_upsert_numbering_delivery(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", None)], "k string, v int")
    assert sorted((r.k, r.v) for r in curation.upserted(old, new, ["k"], ["v"]).collect()) == [("a", 1), ("b", 4), ("c", None)]
    rows = spark.createDataFrame([("x" if i % 3 else "y", f"{i:03d}") for i in range(100)], "rule_id string, id string")
    idx = {r.id: r.idx for r in curation.numbered(rows, ["id"]).collect()}
    for rule in ("x", "y"):
        own = sorted(i for i in idx if idx[i].startswith(f"syn-{rule}-"))
        assert [idx[i] for i in own] == [f"syn-{rule}-{n + 1}" for n in range(len(own))]
    twice = spark.createDataFrame([("a", {"k": "v"}), ("a", {"k": "v"}), ("b", None)], "id string, m map<string,string>")
    assert delivered_once(twice, "id").count() == 2


def brute_retries(rows, most):
    out = {}
    for rule in {r[0] for r in rows}:
        run, gone = 0, False
        for _, i, ok in sorted((r for r in rows if r[0] == rule), key=lambda r: r[1]):
            given = gone
            run = 0 if ok else run + 1
            gone = gone or run >= most
            out[i] = (run, given)
    return out


def test_retries_over_parts(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "cold", None]), i, rng.choice([True, True, True, False, None])) for i in range(900)]
    df = spark.createDataFrame(rows, "rule string, id long, passed boolean")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.id: (r.retries, r.given_up) for r in sequences.retry_limit(df, "rule", ["id"], F.col("passed"), 4).collect()}
        assert got == brute_retries(rows, 4)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sequences.retry_limit(df.limit(0), "rule", ["id"], F.col("passed"), 4).count() == 0


def test_trimmed_null_group(spark):
    df = spark.createDataFrame([(None, i, "tool") for i in range(50)] + [("", i, "tool") for i in range(3)], "c string, i long, role string")
    got = {(r.c, r.i) for r in sequences.trimmed(df, "c", ["i"], F.col("role") == "user").collect()}
    assert got == {(None, i) for i in (0, *range(26, 50))} | {("", i) for i in range(3)}


def test_mentions(spark):
    from lapidary.operators.search import mentions

    docs = spark.createDataFrame([(1, "the red cup and the cup"), (2, None), (3, ""), (4, "a cupboard"), (1, "the red cup and the cup")], "id long, text string")
    names = spark.createDataFrame([("cup",), ("red cup",), ("board",), (None,), ("",), ("cup",)], "s string")
    want = {(1, "cup"), (1, "red cup"), (1, ""), (3, ""), (4, "cup"), (4, "board"), (4, "")}
    for chars in (1000, 6):
        rows = [(r.key, r.string) for r in mentions(docs, "id", "text", names, "s", chars).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert mentions(docs, "id", "text", names.limit(0), "s").count() == 0


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_split(spark):
    """A third of the rows on one key, limits lowered: the joins of first occurrences and of the gate are split."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "60KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        hot = F.when(F.col("id") % 3 == 0, "the same question").otherwise(F.concat(F.lit("question "), F.col("id").cast("string")))
        rows = spark.range(0, 60_000, 1, 8).select(F.col("id"), hot.alias("question"), F.sha2(F.col("id").cast("string"), 512).alias("answer"), F.lit("10").alias("rule_id"))
        evals = rows.limit(200).withColumn("item_id", F.col("id"))
        assert "skew=true" in _final_plan(curation.with_first(rows, F.col("question"), ["id"]))
        assert "skew=true" in _final_plan(curation.gate(rows, evals, ["id"]))
        assert "skew=true" in _final_plan(sequences.previous_batch(rows, "question", ["id"], F.col("id") % 2 == 0))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
