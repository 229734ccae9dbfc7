"""Streams over logs of generation: windowed pass rates, a key-value store with expiry, acceptance of micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as they arrive; time columns without a zone become timestamps, which watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in raw.schema.fields])


def windowed_rates(log: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, rule_id, total, passed) of tumbling windows; rows later than the watermark are dropped on a stream."""
    timed = log.where("created_at is not null").withWatermark("created_at", late)
    out = timed.groupBy(F.window("created_at", width).alias("w"), "rule_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"))
    return out.select(F.col("w.start").alias("start"), "rule_id", "total", "passed")


def _expiring(ttl: int):
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, value = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "value": [value], "at": [pd.Timestamp(at, unit="us")], "expired": [True]})
            return
        best = state.get if state.exists else None
        for pdf in frames:
            for at, value in zip(pdf["at"], pdf["value"]):
                us = int(at.value // 1000)
                if best is None or us >= best[0]:
                    best = (us, value)
        if best is not None:
            state.update(best)
            state.setTimeoutTimestamp(max(best[0] // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({"key": [key[0]], "value": [best[1]], "at": [pd.Timestamp(best[0], unit="us")], "expired": [False]})

    return update


def expiring_store(writes: DataFrame, ttl: int, late: str = "0 seconds") -> DataFrame:
    """(key, value, at, expired): the last value of each key as it changes, and again, as expired, when its time is over.

    ``writes`` has key, value (strings) and at. State is kept per key and removed when it expires.
    """
    timed = writes.select("key", "value", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    schema = "key string, value string, at timestamp, expired boolean"
    return timed.groupBy("key").applyInPandasWithState(_expiring(ttl), schema, "at bigint, value string", "update", GroupStateTimeout.EventTimeTimeout)


def accept_batches(stream: DataFrame, path: str, key: str, checkpoint: str):
    """A query that appends to a Parquet table the rows of each micro-batch whose key the table doesn't have yet.

    Every batch writes its own folder, replaced if the batch is run again, so a batch counts once even after a failure.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        once = batch.dropDuplicates([key])
        earlier = [s.getPath().toString() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))] if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)) else []
        earlier = [p for p in earlier if "batch=" in p and not p.endswith(f"batch={number}")]
        if earlier:
            once = once.join(spark.read.parquet(*earlier).select(key), key, "left_anti")
        once.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_rates(log: DataFrame) -> DataFrame:
    """(rule_id, total, passed) over everything that has arrived, each id once."""
    once = log.dropDuplicates(["id"])
    return once.groupBy("rule_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"))


def run_to_table(aggregated: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream of aggregates over what is there and return the table of its last state, which every batch replaces."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state={number % 2}")
        batch.sparkSession.createDataFrame([(number % 2,)], "state int").coalesce(1).write.mode("overwrite").parquet(f"{path}-last")

    q = aggregated.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = aggregated.sparkSession
    return spark.read.parquet(f"{path}/state={spark.read.parquet(f'{path}-last').first().state}")
