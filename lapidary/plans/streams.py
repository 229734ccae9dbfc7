"""A stream over the log of generation as a query."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lapidary.plans.catalog import L, query
from lapidary.session import checkpoint_folder
from lapidary.sources.tables import table
from lapidary.streaming import logs


@query(f"WITH {L} SELECT rule_id, count(*) AS total, count_if(coalesce(passed, false)) AS passed FROM l GROUP BY rule_id")
def stream_rates(spark: SparkSession, base: str) -> DataFrame:
    """Totals by rule kept by a stream that reads the table's files as they come, a few at a time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/generation_log.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    # A stream reads folders; a table of one file is picked out of its folder by name.
    folder = base if fs.getFileStatus(path).isFile() else path.toString()
    reader = spark.readStream.schema(table(spark, base, "generation_log").select("id", "rule_id", "passed").schema).option("maxFilesPerTrigger", 8)
    if folder == base:
        reader = reader.option("pathGlobFilter", "generation_log.parquet")
    work = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4()}"
    return logs.run_to_table(logs.total_rates(reader.parquet(folder)), f"{work}/rates", f"{work}/progress")
