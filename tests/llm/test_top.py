import datetime as dt
import math
import random

import pytest

from lapidary.llm import top

SCHEMA = "id string, rule_id string, reviewer_score double, created_at timestamp_ntz, position int"


def brute(rows, n):
    out, groups = set(), {}
    for r in set(rows):
        if r[1] is not None and r[2] is not None and not math.isnan(r[2]) and r[3] is not None:
            groups.setdefault((r[1], r[3].strftime("%Y-%m-%d")), []).append(r)
    for k, g in groups.items():
        for i, r in enumerate(sorted(g, key=lambda r: (-r[2], -r[3].timestamp(), r[0]))[:n]):
            out.add((*k, r[0], i + 1))
    return out


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
@pytest.mark.parametrize("batch", ["3", "10000"])
def test_against_brute_force(spark, partitions, batch):
    rng = random.Random(int(partitions))
    start = dt.datetime(2020, 1, 1)
    rows = []
    for i in range(400):
        rule = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
        score = rng.choice([1.0, 2.0, 3.0, math.nan, None])
        at = None if rng.random() < 0.05 else start + dt.timedelta(hours=rng.randrange(60))
        rows.append((f"i{i:04d}", rule, score, at, 0))
    rows += rng.sample(rows, 40)
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        got = [tuple(r) for r in top.best_puzzles(df).select("rule_id", "created_day", "id", "position").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got))
    assert set(got) == brute([r[:4] for r in rows], 3)


def test_empty(spark):
    assert top.best_puzzles(spark.createDataFrame([], SCHEMA)).count() == 0
