"""Generic file scans and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, a missing path is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; ``mode='append'`` adds files to the folder."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file for a result-sized table (rankings, folds, stages, curves)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_raw(df: DataFrame, root: str, source: str, run_date: str) -> None:
    """Raw snapshot under ``source=/run_date=``; re-running a day replaces that day only."""
    (
        df.withColumn("source", F.lit(source))
        .withColumn("run_date", F.lit(run_date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source", "run_date")
        .parquet(root)
    )


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
