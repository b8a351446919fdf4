"""Exactly-once storage by id at any age, reading only what may hold the ids of a batch.

Ids lie in hash buckets, one segment for each batch that brought new ids of the bucket, and each segment has a Bloom
filter. A batch reads the filters of the buckets of its ids, then only those segments whose filter holds one of them.
With ``buckets`` well above the ids of a usual batch, what it reads follows the batch and not the store.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risewatch.operators.extract import dedupe_by_id

#: Bits of a filter for each id, and hash functions: about one false hit in a hundred.
BITS, HASHES = 10, 7
_FILTER = "bucket bigint, batch bigint, bits binary"


def _places(keys: np.ndarray, size: int) -> np.ndarray:
    """Bits of 64-bit keys in a filter of ``size`` bits, by double hashing of the two halves."""
    keys = keys.view(np.uint64)
    a, b = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(size)).astype(np.int64)


def bloom(keys: np.ndarray) -> bytes:
    size = max(64, -(-BITS * len(keys) // 8) * 8)
    bits = np.zeros(size, np.uint8)
    bits[_places(keys, size).ravel()] = 1
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, keys: np.ndarray) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(bits, np.uint8))
    return flat[_places(keys, len(flat))].all(axis=1)


class IdStore:
    """Rows with an id at ``path/rows``; ``path/ids`` and ``path/filters`` are the index. ``buckets`` is fixed by the first use."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, ident: str = "id"):
        self.spark, self.path, self.buckets, self.ident = spark, path, buckets, ident

    def begin(self) -> None:
        """An empty filter for every bucket, so that each bucket's folder exists; later calls find them."""
        try:
            self.spark.read.schema(_FILTER).parquet(f"{self.path}/filters/bucket=0")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            empty = self.spark.range(self.buckets).select(F.col("id").alias("bucket"), F.lit(-1).cast("bigint").alias("batch"), F.lit(bloom(np.zeros(0, np.int64))).alias("bits"))
            empty.write.partitionBy("bucket", "batch").parquet(f"{self.path}/filters")

    def keyed(self, rows: DataFrame) -> DataFrame:
        key = F.xxhash64(F.col(self.ident).cast("string"))
        return rows.select(F.col(self.ident).cast("string").alias("id"), key.alias("key"), F.pmod(F.xxhash64(F.lit(7), key), F.lit(self.buckets)).alias("bucket"))

    def segments(self, ids: DataFrame, batch_id: int) -> list[str]:
        """Folders of the id segments, of other batches, that may hold one of ``ids`` (id, key, bucket)."""
        touched = [r["bucket"] for r in ids.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return []
        base = f"{self.path}/filters"
        filters = self.spark.read.schema(_FILTER).option("basePath", base).parquet(*[f"{base}/bucket={b}" for b in touched]).where((F.col("batch") >= 0) & (F.col("batch") != batch_id))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            keys = left.column("key").to_numpy()
            hit = [len(keys) > 0 and bool(may_hold(bits, keys).any()) for bits in right.column("bits").to_pylist()]
            return right.select(["bucket", "batch"]).filter(pa.array(hit, pa.bool_()))

        found = ids.select("bucket", "key").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(meet, "bucket bigint, batch bigint")
        return [f"{self.path}/ids/bucket={r['bucket']}/batch={r['batch']}" for r in found.collect()]  # segments of the touched buckets

    def seen(self, ids: DataFrame, batch_id: int) -> DataFrame:
        """Stored ids among those that may equal one of ``ids``."""
        folders = self.segments(ids, batch_id)
        if not folders:
            return self.spark.createDataFrame([], "id string")
        return self.spark.read.schema("id string, key bigint").parquet(*folders).select("id")

    def append(self, batch: DataFrame, batch_id: int, order: str) -> None:
        """Rows whose id was never stored, the first of each id; a retried batch replaces what it wrote before.

        The rows are written first and the index after them, from the written rows. A batch that failed in between is
        run again by the stream before any other, so no later batch meets rows without an index.
        """
        self.begin()
        first = dedupe_by_id(batch, F.col(order), self.ident).persist()
        fresh = first.join(self.seen(self.keyed(first), batch_id), F.col(self.ident).cast("string") == F.col("id"), "left_anti") if self.ident != "id" else first.join(
            self.seen(self.keyed(first), batch_id).withColumnRenamed("id", "_seen"), F.col("id").cast("string") == F.col("_seen"), "left_anti"
        )
        rows = f"{self.path}/rows/batch={batch_id}"
        fresh.write.mode("overwrite").parquet(rows)
        first.unpersist()
        ids = self.keyed(self.spark.read.schema(batch.schema).parquet(rows)).withColumn("batch", F.lit(batch_id).cast("bigint"))
        by_bucket = ids.repartition("bucket")
        by_bucket.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.path}/ids")

        def filters(table: pa.Table) -> pa.Table:
            keys = table.column("key").to_numpy()
            return pa.table({"bucket": table.column("bucket").slice(0, 1), "batch": pa.array([batch_id], pa.int64()), "bits": pa.array([bloom(keys)], pa.binary())})

        blooms = by_bucket.select("bucket", "key").groupBy("bucket").applyInArrow(filters, _FILTER)
        blooms.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.path}/filters")

    def sink(self, order: str) -> Callable[[DataFrame, int], None]:
        return lambda batch, batch_id: self.append(batch, batch_id, order)

    def rows(self, schema) -> DataFrame:
        """All stored rows, with the batch that brought them."""
        return self.spark.read.option("basePath", f"{self.path}/rows").schema(schema).parquet(f"{self.path}/rows")
