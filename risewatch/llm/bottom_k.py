"""Document fingerprints: the ``k`` least hashes of a text's word shingles, with their number if it is less than ``k``.

A shingle is the five words ending at a word, fewer at the start of a text, so that short texts have shingles too. A
sketch is a sorted array of distinct 64-bit hashes; sketches of parts merge into the sketch of the whole. Resemblance
is the share of common hashes among the ``k`` least of the union; containment and the distinct count follow from the
k-th least hash. Empty texts have an empty sketch: resemblance of two empty sketches is 1, of one empty sketch 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risewatch.llm.common import hash_words, map_texts, shingles, slices, spare

K = 128
SPACE = float(2**64)


def sketches(texts: list[str], k: int = K, width: int = 5) -> list[np.ndarray]:
    flat, off = hash_words([t.split() for t in texts])
    grams = shingles(flat, off, width)
    return [_least(grams[a:b], k) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def _least(values: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` least distinct values; a partition keeps the sort short where repeats are few."""
    if len(values) > 4 * k:
        low = np.unique(np.partition(values, 2 * k)[: 2 * k])
        if len(low) >= k:
            return low[:k]
    return np.unique(values)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of a text of which ``a`` and ``b`` sketch the parts' shingles."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(common, union[-1], "right") / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles: exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / SPACE)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of ``a``'s shingles that are in ``b``."""
    if not len(a):
        return 1.0
    union = distinct(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / max(1.0, distinct(a, k)))


def to_hex(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_hex(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def fingerprint(df: DataFrame, text: str, k: int = K) -> DataFrame:
    """Adds ``fingerprint`` (hex of the sketch) and ``n_shingles`` (estimate). Null texts are empty."""
    names = spare(df.columns, "fingerprint", "n_shingles")
    schema = T.StructType([*df.schema.fields, T.StructField(names[0], T.StringType(), False), T.StructField(names[1], T.DoubleType(), False)])

    def work(part, texts):
        all_ = sketches(texts, k)
        return pa.RecordBatch.from_arrays([*part.columns, pa.array([to_hex(s) for s in all_], pa.string()), pa.array([distinct(s, k) for s in all_])], [*part.schema.names, *names])

    return map_texts(df, text, work, schema)


def merge_fingerprints(df: DataFrame, by: list[str], fingerprint: str, k: int = K) -> DataFrame:
    """One fingerprint for each value of ``by``: hashes are deduplicated map-side, then the ``k`` least are kept."""
    starts = F.sequence(F.lit(1), F.length("p") - 15, F.lit(16))
    hashes = F.when(F.length("p") >= 16, F.transform(starts, lambda i: F.substring("p", i, F.lit(16)))).otherwise(F.array().cast("array<string>"))
    rows = df.select(*by, F.col(fingerprint).alias("p")).select(*by, F.explode_outer(hashes).alias("h")).distinct()
    w = Window.partitionBy(*by).orderBy(F.col("h").asc_nulls_last())
    top = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("h")), "").alias(fingerprint))


def edited_pairs(df: DataFrame, doc_id: str, text: str, k: int = K, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness.

    The last third of a text (floor of its code points / 3) is replaced by the start of the text that follows by
    descending id; the last is followed by the first, a single row by itself. Rows of null id come last, equal ids in
    text order. Returns id, n_chars, edited (the text), fingerprint, edited_fingerprint, near_edited, near_next.

    Ids are cut into ranges; each range is sorted and read once in a task, with a copy of the text that follows its
    last row. One shuffle of the texts; only range ends (a few for each task) come to the driver.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = df.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = base.select("id")
    found = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n + 1)], 10000).alias("q")).first()["q"] or []
    bounds = sorted(set(found))
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def range_of(v: pd.Series) -> pd.Series:
        known = v.notna()
        return pd.Series(np.where(known, 1 + np.searchsorted(edges, v.fillna(0).astype("int64")), 0).astype("int32"))

    rows = base.select("id", "text", range_of("id").alias("bucket"))
    # the first row of each range by descending id, then by text
    firsts = rows.groupBy("bucket").agg(F.max("id").alias("id")).collect()
    order = sorted((r["bucket"] for r in firsts), reverse=True)
    above = {b: order[i - 1] for i, b in enumerate(order)}  # the range that ends where this one begins; the first wraps
    head = {r["bucket"]: r["id"] for r in firsts}
    copies = [(b, head[b], above[b]) for b in order]
    marks = spark.createDataFrame(copies, "bucket int, id bigint, goes int")
    heads = rows.join(F.broadcast(marks), (rows["bucket"] == marks["bucket"]) & rows["id"].eqNullSafe(marks["id"]), "inner")
    heads = heads.groupBy(F.col("goes").alias("bucket")).agg(F.min("text").alias("text"))
    every = rows.withColumn("extra", F.lit(False)).unionByName(heads.select(F.lit(None).cast("bigint").alias("id"), "text", "bucket", F.lit(True).alias("extra")))
    dealt = every.repartitionByRange(max(n, 1), "bucket").sortWithinPartitions("bucket", "extra", F.col("id").desc_nulls_last(), "text")
    schema = "id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(lambda batches: _edit(batches, k), schema).withColumnRenamed("id", doc_id)


def _edit(batches, k: int):
    """Sorted rows of whole ranges -> results; a row waits for the one after it."""
    held: list = []  # the last row of a range so far: (id, text, sketch, bucket)

    def out(rows):
        edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for _, t, _, after, _ in rows]
        own = sketches(edited, k)
        return pa.RecordBatch.from_pydict(
            {
                "id": pa.array([r[0] for r in rows], pa.int64()), "n_chars": pa.array([len(r[1]) for r in rows], pa.int64()), "edited": pa.array(edited, pa.string()),
                "fingerprint": pa.array([to_hex(r[2]) for r in rows], pa.string()), "edited_fingerprint": pa.array([to_hex(s) for s in own], pa.string()),
                "near_edited": pa.array([resemblance(r[2], s, k) for r, s in zip(rows, own)], pa.float64()),
                "near_next": pa.array([resemblance(r[2], r[4], k) for r in rows], pa.float64()),
            }
        )

    for batch in batches:
        for part, texts in slices(batch, "text"):
            buckets, extra, ids = part.column("bucket").to_pylist(), part.column("extra").to_pylist(), part.column("id").to_pylist()
            ready = []
            for i, (t, s) in enumerate(zip(texts, sketches(texts, k))):
                if held and held[3] == buckets[i]:
                    ready.append((held[0], held[1], held[2], t, s))
                held = [] if extra[i] else [ids[i], t, s, buckets[i]]
            if ready:
                yield out(ready)
