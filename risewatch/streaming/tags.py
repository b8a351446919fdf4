"""Online zero-run and sudden-drop tags as a state machine with timers and expiring state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from risewatch.operators.activity import API_FAILURE, SUDDEN_DROP

OUT = "topic_id string, source string, window_start string, value double, tag string"
LATE, SILENT = "late", "silent"
#: The store that keeps keyed state outside the heap; ``transformWithState`` asks for it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OnlineTags(StatefulProcessor):
    """State of one (topic, source): run lengths, the windows of a zero run that is not long enough yet, and its timer.

    Rows come in order of ``window_start``; one at or before the last window is ``late``. A zero run is reported from
    its first zero once it has ``min_zeros``, so the tags equal those of the batch form. A series without rows for
    ``quiet_ms`` is reported as ``silent`` once and its state is dropped; state nobody touches expires after ``ttl_ms``.
    """

    def __init__(self, min_zeros: int, min_before: int, quiet_ms: int, ttl_ms: int):
        self.min_zeros, self.min_before, self.quiet_ms, self.ttl_ms = min_zeros, min_before, quiet_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "last string, zeros int, positives int, waiting array<string>, timer bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, zeros, positives, waiting, timer = self.run.get() or ("", 0, 0, [], None)
        waiting = list(waiting)
        batch = pd.concat(list(rows)).sort_values("window_start", kind="stable")
        out: list[tuple[str, float, str]] = []
        for start, value in zip(batch["window_start"], batch["value"]):
            if start is None or start <= last:
                out.append((start, value, LATE))
                continue
            last = start
            if value > 0:
                positives, zeros, waiting = positives + 1, 0, []
                continue
            if positives >= self.min_before:
                out.append((start, value, SUDDEN_DROP))
            positives = 0
            if value != 0:
                zeros, waiting = 0, []
                continue
            zeros += 1
            waiting.append(start)
            if zeros >= self.min_zeros:
                out.extend((w, 0.0, API_FAILURE) for w in waiting)
                waiting = []
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.handle.registerTimer(timer)
        self.run.update((last, zeros, positives, waiting, timer))
        yield self.table(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.run.get()
        self.run.clear()
        yield self.table(key, [(held[0] if held else None, None, SILENT)])

    def close(self) -> None:
        pass

    @staticmethod
    def table(key, rows) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=["topic_id", "source", "window_start", "value", "tag"])


def online_tags(
    df: DataFrame, min_zeros: int = 3, min_before: int = 3, quiet_ms: int = 45 * 86_400_000, ttl_ms: int = 90 * 86_400_000
) -> DataFrame:
    """Tags of a stream of (topic_id, source, window_start, value); rows with a null value count as not reported and are left out."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = df.select("topic_id", "source", F.col("window_start").cast("string"), F.col("value").cast("double")).where("value is not null")
    return rows.groupBy("topic_id", "source").transformWithStateInPandas(
        OnlineTags(min_zeros, min_before, quiet_ms, ttl_ms), outputStructType=OUT, outputMode="append", timeMode="ProcessingTime"
    )


def tag_sink(tags: str, side: str) -> Callable[[DataFrame, int], None]:
    """Tags into one table; late and silent series into a side table. A retried batch replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        aside = F.col("tag").isin(LATE, SILENT)
        for path, rows in ((tags, batch.where(~aside)), (side, batch.where(aside))):
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    return write


def run_tags(df: DataFrame, tags: str, side: str, checkpoint: str, **limits) -> None:
    """Tag everything that is available, then stop; a later run resumes with the state it left.

    A query with processing-time timers asks for batches without data for ever. A run that is to end goes without them:
    timers that are due fire with its data, a stream that is always on fires them by itself.
    """
    conf, idle = df.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(idle)
    conf.set(idle, "false")
    try:
        q = online_tags(df, **limits).writeStream.foreachBatch(tag_sink(tags, side)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        conf.set(idle, before)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUT + ", batch bigint").parquet(path)
