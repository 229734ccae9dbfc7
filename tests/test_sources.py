import json

from lapidary.sources import config, jsonl


def test_lines(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text("﻿" + json.dumps({"rule_id": "1", "question": "q", "extra": 1}) + "\n\n{broken\n[1]\n" + json.dumps({"rule_id": None}) + "\n", encoding="utf-8")
    good, bad = jsonl.read_lines(spark, str(p), jsonl.EVAL_SCHEMA)
    assert [(r.rule_id, r.question) for r in good.collect()] == [("1", "q"), (None, None)]
    assert sorted(r.line for r in bad.collect()) == ["[1]", "{broken"]


def test_write_keeps_old_when_empty(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("1", "q", "a"), ("2", "", "a"), ("3", None, "a")], "rule_id string, question string, answer string")
    assert jsonl.export(df, out)
    assert spark.read.json(out).count() == 1 and spark.read.json(out).first().idx.startswith("syn-1-")
    assert not jsonl.write_lines(df.limit(0), out)
    assert spark.read.json(out).count() == 1


def test_report(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text("﻿" + json.dumps({"totals": {"accepted": 3}}, indent=1), encoding="utf-8")
    assert jsonl.read_report(spark, str(p)).first().totals.accepted == 3


def test_prior(spark):
    df = spark.createDataFrame([("1", "one two three four"), ("1", "One two three five"), ("1", "one two three four"), ("2", None)], "rule_id string, question string")
    rows = {r.rule_id: (r.n, r.prints, r.topics) for r in jsonl.prior_output(df).collect()}
    assert rows == {"1": (3, 2, 1), "2": (1, 0, 0)}


def test_upsert_table(spark, tmp_path):
    path = str(tmp_path / "facts")
    schema = "key string, value string, at int"
    jsonl.save_upserted(spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], schema), path, ["key"], ["at"])
    jsonl.save_upserted(spark.createDataFrame([("a", "2", 2), ("c", "1", 1)], schema), path, ["key"], ["at"])
    assert sorted((r.key, r.value) for r in spark.read.parquet(path).collect()) == [("a", "2"), ("b", "1"), ("c", "1")]


def test_config(tmp_path, monkeypatch):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"seed": 5, "items_per_rule": 0}))
    monkeypatch.setenv("LAPIDARY_ITEMS_PER_RULE", "7")
    monkeypatch.setenv("LAPIDARY_SEED", "9")
    c = config.load(str(p), rules=["1"])
    assert (c.rules, c.seed, c.items_per_rule, c.max_retries) == (["1"], 5, 7, 3)
    assert config.active_version(None, "builtin", None, None) == "builtin" and config.active_version(None, "v", "f", "p") == "v"
    assert config.active_version("e", "v", "f", "p") == "e" and config.active_version(None, "builtin", None, "p") == "p"


def test_sinks(spark, tmp_path):
    from lapidary.sources import sinks

    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("s", "1", True, ["a"], 5), ("s", None, None, None, None)], "session_id string, rule_id string, passed boolean, errors array<string>, latency_ms int")
    sinks.append_log(rows, path)
    sinks.append_log(rows.limit(1), path)
    got = sorted((r.passed, r.errors, r.latency_ms) for r in spark.read.parquet(path).collect())
    assert got == [(0, "[]", 0), (1, '["a"]', 5), (1, '["a"]', 5)]
    runs = str(tmp_path / "runs")
    for run, n in (("r1", 3), ("r2", 2), ("r1", 1)):
        sinks.write_run(spark.range(1), spark.range(n), runs, run)
    assert {(r.run_id, r["count"]) for r in sinks.read_runs(spark, runs).groupBy("run_id").count().collect()} == {("r1", 1), ("r2", 2)}


def test_no_private_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from lapidary.session import checkpoint_folder

    class Conf:
        @staticmethod
        def get(*_):
            return None

    none = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: Conf, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError):
        checkpoint_folder(SimpleNamespace(sparkContext=sc, conf=Conf))
