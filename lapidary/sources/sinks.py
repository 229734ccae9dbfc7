"""Sinks: logs that only grow, and reports of runs, a folder for each run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(rows: DataFrame, path: str) -> None:
    """Append log rows (session_id, rule_id, agent_role, stage, passed, errors, latency_ms): passed as 0 or 1, errors as JSON, no latency as 0.

    A null outcome hasn't passed; null errors are an empty list."""
    errors = F.to_json(F.coalesce("errors", F.array().cast("array<string>")))
    kept = rows.withColumns({"passed": F.coalesce(F.col("passed").cast("int"), F.lit(0)), "errors": errors, "latency_ms": F.coalesce("latency_ms", F.lit(0))})
    kept.write.mode("append").parquet(path)


def write_run(report: DataFrame, records: DataFrame, folder: str, run: str) -> None:
    """The report (JSON) and the accepted records (Parquet) of a run in its own folder; a run written again replaces only itself."""
    report.coalesce(1).write.mode("overwrite").json(f"{folder}/run_id={run}/report")
    records.write.mode("overwrite").parquet(f"{folder}/run_id={run}/records")


def read_runs(spark, folder: str) -> DataFrame:
    """The records of all runs with their run_id."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/run_id=*/records")
