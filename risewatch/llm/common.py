"""Shared helpers: durable tables, Arrow batches, word hashing and hash mixing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 1 << 20
#: Words remembered by a Python worker before it forgets them all.
MEMORY_WORDS = 150_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; the session's own helper sets one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    from risewatch.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: lineage is cut, lost executors cannot change it."""
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spare(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores added until it clashes with none of ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def total_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts: one narrow pass that sizes partitions."""
    return df.agg(F.sum(F.octet_length(F.col(text)).cast("bigint"))).first()[0] or 0


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch holding about ``limit`` bytes of text, with the texts (null: empty)."""
    column = batch.column(batch.schema.get_field_index(text))
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    group = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            part = batch.slice(lo, hi - lo)
            yield part, [x or "" for x in column.slice(lo, hi - lo).to_pylist()]


def map_texts(df: DataFrame, text: str, work: Callable, schema: str) -> DataFrame:
    """``work(part, texts) -> RecordBatch`` over slices of the Arrow batches of ``df``."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, text):
                yield work(part, texts)

    return df.mapInArrow(run, schema)


class WordHasher(dict):
    """Word -> 64-bit hash, remembered; forgets everything beyond ``MEMORY_WORDS``."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHasher()


def hash_words(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offsets of the lists."""
    off = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=off[1:])
    get = _words.__getitem__
    flat = np.fromiter((h for x in lists for h in map(get, x)), np.uint64, int(off[-1]))
    return flat, off


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(flat: np.ndarray, off: np.ndarray, width: int = 5) -> np.ndarray:
    """One hash for each word: of the ``width`` words that end there, fewer at the start of a text."""
    place = np.arange(len(flat)) - np.repeat(off[:-1], np.diff(off))
    out = flat * _GOLDEN
    for back in range(1, width):
        prior = np.zeros_like(flat)
        prior[back:] = flat[:-back] if back else flat
        prior[place < back] = 0
        out = mix(out + prior * _GOLDEN + np.uint64(back))
    return out
