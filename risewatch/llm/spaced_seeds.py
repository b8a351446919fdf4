"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words under the ones of a fixed mask laid at a position; its zeros are positions at which a
word may be replaced. Seeds of the benchmark are met by the seeds of every position of every text; each hit gives a
benchmark item and a diagonal, along which the words are compared: the best run of aligned words, a match counting
``1`` and a replaced word ``-2``, is an overlap if it has ``least`` matching words (for a shorter item, ``share`` of its
words). Items of fewer than ``shortest`` words would occur everywhere and are left out. The masks reach every overlap of
the default ``least`` and ``share``, or of stricter ones.

The benchmark's seeds are hashed by Spark and sent to the tasks in blocks of at most ``BLOCK`` seeds: one pass over the
texts for each block, one block for a million seeds. Texts are not shuffled, so hot passages or sources cost nothing.

Words are split at white space, without case and outer punctuation. Null and empty texts or items have no overlap.
Repeated rows get equal overlaps. An empty benchmark or table gives no overlap. Extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risewatch.llm.common import hash_words, mix, slices, spare

#: Fixed masks: six words of at most ten. Every run of the rule (12 matches, or 80 % of an item of 10 to 14 words; a replaced
#: word costs two) holds one of them at some position, as the test enumerates.
MASKS = ("1101010011", "11101101", "110010111", "11010111", "111111")
SPAN = max(map(len, MASKS))
BLOCK = 1 << 20
OVERLAP = T.StructType(
    [T.StructField("item_id", T.LongType()), T.StructField("n_matched", T.LongType()), T.StructField("share", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]
)
_EDGE = ".,;:!?\"'`()[]{}<>|*_#"


def words(text: str) -> list[str]:
    return [w.strip(_EDGE) or w for w in text.lower().split()]


def seeds(flat: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked words from each position on; as many as fit into ``flat``."""
    n = len(flat) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), np.uint64)
    if n > 0:
        for j, c in enumerate(mask):
            if c == "1":
                out += flat[j : j + n] * np.uint64(2 * (0x5851F42D4C957F2D * (j + 1) % 2**62) + 1)
    return mix(out)


def masks_of(length: int) -> tuple[str, ...]:
    """Masks of an item. Below ``SPAN`` words one word may be lost: at an end, or between three words and three."""
    if length >= SPAN:
        return MASKS
    inner = ("1" * j + "0" + "1" * (length - 1 - j) for j in range(3, length - 3))
    return ("1" * max(1, length - 1), *inner)


def item_seeds(items: DataFrame, item_id: str, text: str, shortest: int) -> DataFrame:
    """(item, n seeds, words' hashes as bytes) of the items long enough."""

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_pylist()
            flat, off = hash_words([words(t or "") for t in batch.column("text").to_pylist()])
            keep = [i for i in range(len(ids)) if ids[i] is not None and off[i + 1] - off[i] >= shortest]
            yield pa.RecordBatch.from_pydict(
                {"id": pa.array([ids[i] for i in keep], pa.int64()), "n": pa.array([len(masks_of(n)) * n for n in np.diff(off)[keep].tolist()], pa.int64()), "words": pa.array([flat[off[i] : off[i + 1]].tobytes() for i in keep], pa.binary())}
            )

    return items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id bigint, n bigint, words binary")


class Probe:
    """A block of items: sorted seeds with item and place, and a bit table that answers most misses."""

    BITS = 24

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [(i, np.frombuffer(w, np.uint64)) for i, w in items]
        users: dict[str, list[int]] = {}
        for n, (_, w) in enumerate(self.items):
            for mask in masks_of(len(w)):
                users.setdefault(mask, []).append(n)
        self.tables = []
        for mask, own in users.items():
            parts = [(seeds(self.items[n][1], mask), n) for n in own]
            values = np.concatenate([np.zeros(0, np.uint64), *(v for v, _ in parts)])
            item = np.concatenate([np.zeros(0, np.int64), *(np.full(len(v), n) for v, n in parts)])
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(v)) for v, _ in parts)])
            order = np.argsort(values, kind="stable")
            bits = np.zeros(1 << self.BITS, bool)
            bits[(values >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            self.tables.append((mask, values[order], item[order], place[order], bits))

    def hits(self, flat: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Distinct (text, item, place of the item's first word in the text)."""
        found = [np.zeros((0, 3), np.int64)]
        for mask, values, item, place, bits in self.tables:
            own = seeds(flat, mask)
            at = np.flatnonzero(bits[(own >> np.uint64(64 - self.BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(values, own[at], "left"), np.searchsorted(values, own[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            text = np.searchsorted(off, at, "right") - 1
            whole = at + len(mask) <= off[text + 1]
            at, lo, n, text = at[whole], lo[whole], n[whole], text[whole]
            which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.append(np.column_stack([np.repeat(text, n), item[which], np.repeat(at - off[text], n) - place[which]]))
        return np.unique(np.concatenate(found), axis=0)

    def overlaps(self, flat: np.ndarray, off: np.ndarray, least: int, share: float) -> list[dict[int, tuple]]:
        """For each text: item -> (matches, share of the item, first word in the text, words) of its best overlap."""
        out: list[dict[int, tuple]] = [{} for _ in range(len(off) - 1)]
        for text, n, start in self.hits(flat, off).tolist():
            item, known = self.items[n]
            lo, hi = max(0, start), min(int(off[text + 1] - off[text]), start + len(known))
            same = flat[off[text] + lo : off[text] + hi] == known[lo - start : hi - start]
            first, last, matched = best_run(same)
            need = min(least, int(np.ceil(share * len(known))))
            if matched >= need and (item not in out[text] or (matched, -lo - first) > (out[text][item][0], -out[text][item][2])):
                out[text][item] = (matched, matched / len(known), lo + first, last - first)
        return out


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of the run of the best score; the earliest of equals."""
    if not same.any():
        return 0, 0, 0
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total[1:] - low[:-1])) + 1
    start = int(np.flatnonzero(total[:end] == low[end - 1])[-1])
    return start, end, int(same[start:end].sum())


def mark(df: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, least: int = 12, share: float = 0.8, shortest: int = 5, block: int = BLOCK) -> DataFrame:
    """Adds ``overlaps``: the benchmark items found in each text with the best overlap of each, by item."""
    name = spare(df.columns, "overlaps")[0]
    spark = df.sparkSession
    own = item_seeds(items, item_id, item_text, shortest)
    total = own.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, -(-total // block))
    own = own.select("id", "words", F.pmod(F.xxhash64("id", "words"), F.lit(n_blocks)).alias("block")).distinct()
    out = df.withColumn(name, F.array().cast(T.ArrayType(OVERLAP)))
    for i in range(n_blocks):
        rows = own.where(F.col("block") == i).orderBy("id", "words").collect()  # bounded by ``block``
        blob = spark.sparkContext.broadcast([(r["id"], bytes(r["words"])) for r in rows])
        out = _pass(out, text, name, blob, least, share)
    return out


def _pass(df: DataFrame, text: str, name: str, blob, least: int, share: float) -> DataFrame:
    def run(batches):
        probe = Probe(blob.value)
        for batch in batches:
            for part, texts in slices(batch, text):
                flat, off = hash_words([words(t) for t in texts])
                found = probe.overlaps(flat, off, least, share)
                before = part.column(part.schema.get_field_index(name)).to_pylist()
                rows = [sorted(b + [dict(zip(OVERLAP.names, (k, *v))) for k, v in f.items()], key=lambda r: r["item_id"]) for b, f in zip(before, found)]
                column = pa.array(rows, part.schema.field(name).type)
                yield pa.RecordBatch.from_arrays([column if f == name else c for c, f in zip(part.columns, part.schema.names)], part.schema.names)

    return df.mapInArrow(run, df.schema)
