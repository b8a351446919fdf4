"""Runs of an incremental stream with one manifest row each, also when there was nothing to do.

Structured Streaming starts no micro-batch when no file is new, so a sink alone never learns of an idle run. Here a
run ends by looking at what its micro-batches left since the last manifest row; nothing means a no-op row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run_id bigint, started_at string, finished_at string, status string, noop boolean, new_records map<string,bigint>, last_batch bigint"
_COUNTS = "source string, n bigint, bad bigint, batch bigint"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/runs/*")


def _read(spark: SparkSession, schema: str, fmt: str, *paths: str, base: str | None = None) -> DataFrame:
    """A table, empty while nobody has written it."""
    try:
        reader = spark.read.schema(schema).format(fmt)
        return (reader.option("basePath", base) if base else reader).load(list(paths))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def counting_sink(path: str, write: Callable[[DataFrame, int], None], source: str, error: str) -> Callable[[DataFrame, int], None]:
    """Write a micro-batch and leave its counts by source; a retried batch replaces them."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        write(batch.where(F.col(error).isNull()), batch_id)
        per = batch.groupBy(F.coalesce(source, F.lit("unknown")).alias("source")).agg(F.count_if(F.col(error).isNull()).alias("n"), F.count_if(F.col(error).isNotNull()).alias("bad"))
        per.write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
        batch.unpersist()

    return run


def run_once(
    df: DataFrame, path: str, write: Callable[[DataFrame, int], None], source: str = "source", error: str = "error", fail_on_error: bool = True
) -> None:
    """Process what is new, then append one row to the manifest.

    ``new_records`` counts the rows without an error by source. ``noop``: no new row and no failed one. A failed row or a
    failed stream gives status ``error``; the exception of the stream is raised again after its row is written.
    """
    spark = df.sparkSession
    past = _read(spark, MANIFEST, "json", f"{path}/runs").agg(F.coalesce(F.max("run_id"), F.lit(-1)).alias("run"), F.coalesce(F.max("last_batch"), F.lit(-1)).alias("batch")).first()
    started = spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss\")").first()[0]
    failure: Exception | None = None
    try:
        q = (
            df.writeStream.foreachBatch(counting_sink(path, write, source, error))
            .option("checkpointLocation", f"{path}/log")
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()
    except Exception as e:
        failure = e
    # micro-batches since the last manifest row, also those of a run that ended before it could write one
    counts = _read(spark, _COUNTS, "parquet", f"{path}/counts").where(F.col("batch") > past["batch"])
    per = counts.groupBy("source").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("batch").alias("batch"))
    bad = F.coalesce(F.sum("bad"), F.lit(0)) > 0
    failed = (bad if fail_on_error else F.lit(False)) | F.lit(failure is not None)
    row = per.agg(
        F.lit(past["run"] + 1).cast("bigint").alias("run_id"),
        F.lit(started).alias("started_at"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("finished_at"),
        F.when(failed, "error").otherwise("ok").alias("status"),
        ((F.coalesce(F.sum("n"), F.lit(0)) == 0) & ~bad & F.lit(failure is None)).alias("noop"),
        F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("new_records"),
        F.coalesce(F.max("batch"), F.lit(past["batch"])).cast("bigint").alias("last_batch"),
    )
    row.coalesce(1).write.mode("overwrite").json(f"{path}/runs/run={past['run'] + 1}")
    if failure:
        raise failure
