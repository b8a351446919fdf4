"""Incremental forms of the daily run: resumable ingest, dedup, windowed counts, run manifest, online tags."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from risewatch.operators.activity import API_FAILURE, SUDDEN_DROP
from risewatch.operators.extract import append_new
from risewatch.session import ensure_checkpoint_dir


def stream_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def ingest_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "json", **options: str) -> DataFrame:
    """New files of a folder; the query's checkpoint remembers what was read."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(folder)


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Process everything that is available, then stop; a later run resumes from the checkpoint."""
    q = (
        df.writeStream.format(fmt)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(sink)
    )
    q.awaitTermination()


def dedup_stream(df: DataFrame, ts: str = "ts", delay: str = "1 day", ident: str = "id") -> DataFrame:
    """First row per id inside the delay; ids older than the watermark leave the state."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([ident])


def dedup_sink(store: str, order: str, ident: str = "id") -> Callable[[DataFrame, int], None]:
    """Exactly-once append for any age: each micro-batch is anti-joined with everything stored.

    A batch writes its own ``batch`` partition and replaces it when the batch is retried.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        try:
            stored = spark.read.parquet(store).where(F.col("batch") != batch_id)
            rows = append_new(stored, batch, F.col(order), ident)
        except Exception as e:  # the first batch finds no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            from risewatch.operators.extract import dedupe_by_id

            rows = dedupe_by_id(batch, F.col(order), ident)
        (
            rows.withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(store)
        )

    return write


def count_stream(df: DataFrame, key: str, ts: str = "ts", every: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows per key and tumbling window; rows later than the delay are left out. Months roll up from days."""
    return (
        df.withWatermark(ts, delay)
        .groupBy(F.window(ts, every), key)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("bin"), F.col(key).alias("entity"), "cnt")
    )


def manifest_sink(path: str, source: str = "source", error: str = "error") -> Callable[[DataFrame, int], None]:
    """One manifest row per micro-batch: new records per source, and no-op when nothing is new and nothing failed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        per = batch.groupBy(source).agg(
            F.count_if(F.col(error).isNull()).alias("n"), F.count_if(F.col(error).isNotNull()).alias("bad")
        )
        row = per.agg(
            F.map_from_entries(F.collect_list(F.struct(source, "n"))).alias("new_records"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("errors"),
        ).select(
            F.lit(batch_id).alias("run_id"),
            F.current_timestamp().alias("started_at"),
            "new_records",
            ((F.col("total") == 0) & (F.col("errors") == 0)).alias("noop"),
            F.when(F.col("errors") > 0, "error").otherwise("ok").alias("status"),
        )
        row.write.mode("overwrite").json(f"{path}/run_id={batch_id}")

    return write


def weekly_rollup(runs: DataFrame, since: str) -> tuple[DataFrame, DataFrame]:
    """Ok, no-op and failed runs since a date, and new records per source."""
    recent = runs.where(F.coalesce("started_at", F.lit("")) >= since)
    noop = F.coalesce("noop", F.lit(False))
    ok = F.coalesce("status", F.lit("error")) == "ok"
    counts = recent.agg(
        F.count_if(~noop & ok).alias("n_ok"), F.count_if(noop).alias("n_noop"), F.count_if(~noop & ~ok).alias("n_error")
    )
    per = recent.select(F.explode("new_records").alias("source", "n")).groupBy("source").agg(F.sum("n").alias("new_records"))
    return counts, per


_OUT = "topic_id string, source string, window_start string, value double, tag string"
_STATE = "last string, zeros int, positives int, pending array<string>"


def anomaly_stream(df: DataFrame, min_zeros: int = 3, min_before: int = 3) -> DataFrame:
    """Online zero-run and sudden-drop tags per (topic, source); rows out of order come out tagged ``late``.

    The state holds run lengths and at most ``min_zeros - 1`` waiting windows. A zero run is reported from its
    first zero once it is long enough, so the tags equal those of the batch form; a drop that turns out to
    start a long zero run is reported under both tags.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, zeros, positives, pending = state.get if state.exists else ("", 0, 0, [])
        pending = list(pending)
        rows = pd.concat(list(batches)).sort_values("window_start", kind="stable")
        out: list[tuple[str, float, str]] = []
        for start, value in zip(rows["window_start"], rows["value"]):
            if start <= last:
                out.append((start, value, "late"))
                continue
            last = start
            if value > 0:
                positives, zeros, pending = positives + 1, 0, []
                continue
            if positives >= min_before:
                out.append((start, value, SUDDEN_DROP))
            positives = 0
            if value != 0:
                zeros, pending = 0, []
                continue
            zeros += 1
            if zeros < min_zeros:
                pending.append(start)
            else:
                out.extend((p, 0.0, API_FAILURE) for p in pending)
                out.append((start, value, API_FAILURE))
                pending = []
        state.update((last, zeros, positives, pending))
        yield pd.DataFrame(
            [(key[0], key[1], s, v, t) for s, v, t in out], columns=["topic_id", "source", "window_start", "value", "tag"]
        )

    return df.groupBy("topic_id", "source").applyInPandasWithState(
        step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout
    )
