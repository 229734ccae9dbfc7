"""JSON lines in and out: explicit schemas, bad lines kept apart, writes that don't clobber, upserts by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

EVAL_SCHEMA = "rule_id string, title string, tag string, rule_content string, question string, answer string"
RECORD_SCHEMA = (
    "idx string, rule_id string, title string, tag string, question string, answer string, rule_content string, difficulty map<string,string>, "
    "reasoning_trace string, metadata struct<generator_ok:boolean,solver_ok:boolean,reviewer_score:int,reviewer_issues:array<string>,"
    "crosscheck_ok:boolean,structural_ok:boolean,crosscheck_warning:boolean>, additional_info struct<input_data:struct<rule_id:string,idx:string>>"
)


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of JSON lines: ``good`` by the schema, ``bad`` the lines that don't parse. A byte-order mark is left out; blank lines are no rows."""
    typed = StructType.fromDDL(schema).add(StructField("_bad", StringType()))
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("value")).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    object_like = F.rtrim(F.ltrim("value")).rlike(r"(?s)^\{.*\}$")
    fine = F.col("r._bad").isNull() & object_like
    good = parsed.where(fine).select(*[F.col(f"r.{f.name}").alias(f.name) for f in StructType.fromDDL(schema).fields])
    return good, parsed.where(~fine).select(F.col("value").alias("line"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A JSON report of one document, with or without a byte-order mark."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("value"))
    # One document, so its text may go to the driver to learn its schema.
    document = F.lit(whole.first().value)
    return whole.select(F.from_json("value", F.schema_of_json(document)).alias("r")).select("r.*")


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """Write JSON lines unless there is no row, so that an empty run keeps what an earlier one wrote; whether it wrote."""
    if df.isEmpty():
        return False
    df.write.mode(mode).json(path)
    return True


def prior_output(records: DataFrame) -> DataFrame:
    """Per rule of earlier output: rows, distinct fingerprints of questions, distinct topics of three words."""
    from lapidary.functions.text import fingerprint, topic

    keyed = records.select("rule_id", fingerprint("question").alias("print"), topic("question", 3, 60).alias("topic"))
    return keyed.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("print").alias("prints"), F.count_distinct("topic").alias("topics"))


def export(records: DataFrame, path: str) -> bool:
    """Rows with a question and an answer, with an idx made of rule and content where they have none."""
    from lapidary.functions.text import record_id

    good = records.where("coalesce(question, '') <> '' and coalesce(answer, '') <> ''")
    if "idx" not in good.columns:
        good = good.withColumn("idx", F.concat(F.lit("syn-"), F.coalesce("rule_id", F.lit("0")), F.lit("-"), record_id("question", "answer")))
    return write_lines(good, path)


def save_upserted(df: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Merge rows into a Parquet table by key: written beside it first, then swapped in, so a failed run leaves the old table."""
    from lapidary.operators.curation import latest, upserted

    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    jvm = spark._jvm
    target, fresh, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".new", path + ".old"))
    fs = target.getFileSystem(conf)
    merged = upserted(spark.read.parquet(path), df, keys, order) if fs.exists(target) else latest(df, keys, order)
    merged.write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)
