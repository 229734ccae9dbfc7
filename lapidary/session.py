"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    n = cpus if isinstance(cpus, int) else 8
    base = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lapidary")
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a temporary one on a local master (tests); on a cluster that is an error,
    as a folder of one machine is lost with it."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lapidary-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: survives lost executors and cuts the lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
