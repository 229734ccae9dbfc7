import itertools
import json
import random

from pyspark.sql import functions as F

from lapidary.llm import copies


def test_line_fields():
    a = copies.line_fields('{"a": "Hello, World", "b": {"c": 1.5, "d": null}, "e": [1, "x"]}')
    b = copies.line_fields(' {"e":["1","X!"],"b":{"d":null,"c":"1-5"},\n"a":"hello world"} ')
    assert a == b and a is not None
    assert copies.line_fields('{"a": 1') is None and copies.line_fields(None) is None and copies.line_fields("") is None
    assert copies.line_fields('{"A": "x"}') != copies.line_fields('{"a": "x"}')
    assert copies.line_fields('{"a": {}}') != copies.line_fields("{}")
    assert copies.line_fields('{"a": {"b": "1"}}') != copies.line_fields('{"a.b": "1"}')


def pairs(rows):
    return {(r.tab, r.kept_key, r.copy_key) for r in rows}


def test_copies(spark):
    puzzles = spark.createDataFrame([("c", "A b!"), ("a", "a B"), ("b", "ab"), ("b", "ab"), ("d", None), ("e", None), ("f", "…"), ("g", ""), ("h", "other")], "id string, question string")
    finals = spark.createDataFrame([("x", "A b!")], "idx string, question string")
    lines = [("1", '{"q": "One", "t": "x"}'), ("2", '{"t":"X","q":"one."}'), ("3", '{"q": "One"}'), ("4", '{"q": "One"'), ("5", '{"q": "One"'), ("6", None)]
    raw = spark.createDataFrame(lines, "raw_id string, line string")
    got = pairs(copies.copies(puzzles, finals, raw).collect())
    assert got == {("puzzles", "a", "b"), ("puzzles", "a", "c"), ("puzzles", "f", "g"), ("raw_records", "1", "2")}
    assert copies.copies(puzzles.limit(0), finals.limit(0), raw.limit(0)).count() == 0
    assert {(r.kept_key, r.n_copies) for r in copies.collapsed(copies.text_fields(puzzles, "id", "question")).collect()} == {("a", 3), ("f", 2), ("h", 1)}


def test_random_lines_against_brute_force(spark):
    rng = random.Random(2)
    lines = []
    for i in range(200):
        d = {"q": rng.choice(["Ab c", "a-bc", "ABD"]), "t": rng.choice([1, "1", 2, None])}
        if rng.random() < 0.3:
            d["x"] = {"k": rng.choice(["u", "U "])}
        items = list(d.items())
        rng.shuffle(items)
        lines.append((f"{i:03d}", json.dumps(dict(items), indent=rng.choice([None, 1]))))
    got = {(r.kept_key, r.copy_key) for r in copies.classes(copies.parsed_lines(spark.createDataFrame(lines, "raw_id string, line string"), "raw_id", "line")).collect()}
    by = {}
    for k, line in lines:
        by.setdefault(tuple(sorted(copies.line_fields(line).items())), []).append(k)
    assert got == {(min(g), k) for g in by.values() for k in g if k != min(g)}


def test_objects_within_lists(spark):
    lines = [("1", '{"a": [[{"x": 1, "y": 2}]], "b": "Q"}'), ("2", '{"b": "q", "a": [[{"y": "2", "x": "1"}]]}'), ("3", '{"a": [[{"x": 2, "y": 1}]], "b": "Q"}'), ("4", "[[[]]]"), ("5", "no")]
    parsed = copies.parsed_lines(spark.createDataFrame(lines, "raw_id string, line string"), "raw_id", "line")
    assert {(r.kept_key, r.copy_key) for r in copies.classes(parsed).collect()} == {("1", "2")}
    assert {(r.kept_key, r.n_copies) for r in copies.collapsed(parsed).collect()} == {("1", 2), ("3", 1), ("4", 1)}


def test_collisions(spark, monkeypatch):
    """With one fingerprint for all, the fields alone decide."""
    own, one = copies.fingerprint, F.struct(F.lit(1).cast("bigint").alias("low"), F.lit(2).cast("bigint").alias("high"))
    monkeypatch.setattr(copies, "fingerprint", lambda f, seed=0: one if seed < 2 else own(f, seed))
    rows = spark.createDataFrame([(str(k), q) for k, q in enumerate(["b", "a", "B", "a!", "c", "b"])], "id string, question string")
    got = {(r.kept_key, r.copy_key) for r in copies.classes(copies.text_fields(rows, "id", "question")).collect()}
    assert got == {("0", "2"), ("0", "5"), ("1", "3")}


def test_order_of_fields_and_hot_group(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "Same  text").otherwise(F.concat(F.lit("t"), "id")).alias("question"))
    n = copies.classes(copies.text_fields(rows, "id", "question")).count()
    assert n == 999
    one = copies.fingerprint(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")))
    two = copies.fingerprint(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))
    assert spark.range(1).select((one == two).alias("s")).first().s
    assert len(list(itertools.islice(rows.toLocalIterator(), 1))) == 1
