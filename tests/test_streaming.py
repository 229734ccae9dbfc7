import datetime as dt

from pyspark.sql import functions as F

from lapidary.streaming import logs

SCHEMA = "id long, rule_id string, passed boolean, created_at timestamp_ntz"


def _write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_windowed_rates(spark, tmp_path):
    t = dt.datetime(2020, 1, 1)
    folder = str(tmp_path / "in")
    rows = [(i, "1" if i % 2 else "2", i % 3 == 0 or None, t + dt.timedelta(minutes=10 * i)) for i in range(30)]
    _write(spark, folder, rows)
    src = logs.read_stream(spark, folder, spark.read.parquet(folder).schema)
    q = logs.windowed_rates(src).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.rule_id): (r.total, r.passed) for r in spark.sql("select * from rates").collect()}
    batch = logs.windowed_rates(spark.read.parquet(folder).withColumn("created_at", F.col("created_at").cast("timestamp")))
    assert got == {(r.start, r.rule_id): (r.total, r.passed) for r in batch.collect()} and sum(v[0] for v in got.values()) == 30


def test_expiring_store(spark, tmp_path):
    t = dt.datetime(2020, 1, 1)
    folder = str(tmp_path / "kv")
    for rows in ([("a", "1", t), ("b", "1", t), ("a", "2", t + dt.timedelta(seconds=5))], [("c", "1", t + dt.timedelta(hours=3))], [("c", "2", t + dt.timedelta(hours=4))]):
        spark.createDataFrame(rows, "key string, value string, at timestamp_ntz").coalesce(1).write.mode("append").parquet(folder)
    src = logs.read_stream(spark, folder, spark.read.parquet(folder).schema, 1)
    q = logs.expiring_store(src, 3600).writeStream.outputMode("update").format("memory").queryName("kv").trigger(availableNow=True).start()
    q.awaitTermination(180)
    rows = {(r.key, r.value, r.expired) for r in spark.sql("select * from kv").collect()}
    assert ("a", "2", False) in rows and ("c", "2", False) in rows and ("a", "2", True) in rows and ("b", "1", True) in rows


def test_accept_batches(spark, tmp_path):
    folder, out = str(tmp_path / "src"), str(tmp_path / "out")
    t = dt.datetime(2020, 1, 1)
    _write(spark, folder, [(1, "1", True, t), (1, "1", True, t), (2, "1", True, t)])
    _write(spark, folder, [(2, "1", True, t), (3, "1", True, t)])
    schema = spark.read.parquet(folder).schema
    for _ in range(2):
        q = logs.accept_batches(logs.read_stream(spark, folder, schema, 1), out, "id", str(tmp_path / "ck"))
        q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(out).select("id").collect()) == [1, 2, 3]
