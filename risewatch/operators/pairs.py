"""Concept pairs of documents, pruned before they are shuffled.

Two passes over the documents. The first counts pairs in hashed cells, a fixed number of them; a pair in a cell that
was counted less often than asked for cannot be frequent. The second emits only pairs of cells that were. A cell may be
shared by several pairs, so some rare pairs pass, and the exact count that follows removes them; none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of the table of counts: eight for each pair, between these bounds (one byte a cell).
CELLS = (1 << 16, 1 << 24)
#: Cells merged and sent as one row; the largest count of a cell.
PIECE, FULL = 1 << 16, 255


def cells_for(n: int) -> int:
    low, high = CELLS
    return min(high, max(low, 1 << (8 * max(n, 1) - 1).bit_length()))


def pair_cells(a: np.ndarray, b: np.ndarray, cells: int) -> np.ndarray:
    """Cells of pairs of 64-bit concept hashes; the order of a pair matters."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) & np.uint64(cells - 1)).astype(np.int64)


def count_cells(df: DataFrame, of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], cells: int) -> np.ndarray:
    """How often ``of`` names each cell, at most ``FULL``. Tasks send the cells they touched; the driver gets ``cells`` bytes."""

    def fill(batches):
        own = np.zeros(cells, np.uint8)
        for batch in batches:
            for at in of(batch):
                at, n = np.unique(at, return_counts=True)
                own[at] = np.minimum(FULL, own[at] + n)
        for k in range(0, cells, PIECE):
            at = np.flatnonzero(own[k : k + PIECE])
            if len(at):
                body = at.astype(np.uint16).tobytes() + own[k + at].tobytes()
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k // PIECE], pa.int32()), "body": pa.array([body], pa.binary())})

    def merge(batches):
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, body in zip(*(c.to_pylist() for c in batch.columns)):
                into = whole.setdefault(piece, np.zeros(PIECE, np.uint8))
                n = len(body) // 3
                at = np.frombuffer(body, np.uint16, n)
                into[at] = np.minimum(FULL, into[at].astype(np.int64) + np.frombuffer(body, np.uint8, n, 2 * n))
        for piece, part in whole.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "body": pa.array([part.tobytes()], pa.binary())})

    schema = "piece int, body binary"
    out = np.zeros(cells, np.uint8)
    for piece, body in df.mapInArrow(fill, schema).repartition("piece").mapInArrow(merge, schema).collect():
        out[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(body, np.uint8)
    return out


def _positions(column: pa.Array, cut: pa.Array | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and flat positions (row, first, second) of all pairs inside the arrays, rows of one shape at a time.

    A row with a ``cut`` above 0 stands for the pairs of its first ``cut`` entries with the others.
    """
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    cuts = np.zeros(len(size), np.int64) if cut is None else cut.to_numpy().astype(np.int64)
    shape = size * (1 << 32) + cuts
    for key in np.unique(shape[size > 1]):
        rows, n, c = np.flatnonzero(shape == key), int(key >> 32), int(key & 0xFFFFFFFF)
        i, j = np.indices((c, n - c)).reshape(2, -1) + [[0], [c]] if c else np.triu_indices(n, 1)
        step = max(1, 4_000_000 // len(i))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            yield np.repeat(some, len(i)), (start[some][:, None] + i).ravel(), (start[some][:, None] + j).ravel()


def with_hashes(arrays: DataFrame) -> DataFrame:
    return arrays.withColumn("hashes", F.transform("concepts", lambda c: F.xxhash64(c)))


def _cut(arrays: DataFrame) -> Column:
    return F.col("cut") if "cut" in arrays.columns else F.lit(0)


def frequent_concepts(arrays: DataFrame, least: int) -> np.ndarray:
    """Whether a concept cell was counted at least ``least`` times over all ``concepts`` arrays."""
    n = arrays.agg(F.coalesce(F.sum(F.size("concepts").cast("bigint")), F.lit(0))).first()[0]
    cells = cells_for(n)

    def of(batch):
        hashes = batch.column(0).flatten().to_numpy()
        yield pair_cells(hashes, hashes, cells)

    return count_cells(with_hashes(arrays).select("hashes"), of, cells) >= min(least, FULL)


def frequent_cells(arrays: DataFrame, least: int, concepts: np.ndarray | None = None) -> np.ndarray:
    """Whether a cell was counted at least ``least`` times over the pairs of all ``concepts`` arrays.

    With a table of ``concepts`` cells, only pairs of concepts that are true there are counted.
    """
    size, cut = F.size("concepts").cast("bigint"), _cut(arrays)
    held = F.when(cut > 0, cut * (size - cut)).otherwise(size * (size - 1) / 2)
    n = arrays.agg(F.coalesce(F.sum(held), F.lit(0.0)).cast("bigint")).first()[0]
    cells = cells_for(n)
    known = None if concepts is None else arrays.sparkSession.sparkContext.broadcast(concepts)

    def of(batch):
        hashes = batch.column(0).flatten().to_numpy()
        ok = None if known is None else known.value[pair_cells(hashes, hashes, len(known.value))]
        for _, i, j in _positions(batch.column(0), batch.column(1)):
            at = pair_cells(hashes[i], hashes[j], cells)
            yield at if ok is None else at[ok[i] & ok[j]]

    return count_cells(with_hashes(arrays).select("hashes", cut.alias("cut")), of, cells) >= min(least, FULL)


def concept_cells(concepts: DataFrame, cells: int = CELLS[0]) -> np.ndarray:
    """Whether a concept cell holds one of the given concepts."""

    def of(batch):
        hashes = batch.column(0).to_numpy()
        yield pair_cells(hashes, hashes, cells)

    return count_cells(concepts.select(F.xxhash64("concept")), of, cells) > 0


def cells_of_pairs(pairs: DataFrame) -> np.ndarray:
    """Whether a cell holds one of the given pairs (a, b)."""
    cells = cells_for(pairs.count())

    def of(batch):
        yield pair_cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), cells)

    return count_cells(pairs.select(F.xxhash64("a"), F.xxhash64("b")), of, cells) > 0


def pairs_in(arrays: DataFrame, cells: np.ndarray, always: str | None = None) -> DataFrame:
    """``doc, time, a, b`` for the pairs of each array whose cell is true, or both of whose concepts are flagged in ``always``."""
    wanted, n_cells = arrays.sparkSession.sparkContext.broadcast(np.packbits(cells)), len(cells)
    doc, names = arrays.schema["doc"].dataType.simpleString(), ["doc", "time", "a", "b"]
    columns = ["doc", "time", "concepts", "hashes", *([always] if always else [])]

    def run(batches):
        mask = np.unpackbits(wanted.value).astype(bool)[:n_cells]
        for batch in batches:
            concepts, hashes = batch.column(2).flatten(), batch.column(3).flatten().to_numpy()
            flags = batch.column(4).flatten().to_numpy(zero_copy_only=False) if always else None
            for row, i, j in _positions(batch.column(2)):
                good = mask[pair_cells(hashes[i], hashes[j], n_cells)]
                if flags is not None:
                    good |= flags[i] & flags[j]
                if good.any():
                    row, i, j = (pa.array(x[good]) for x in (row, i, j))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), concepts.take(i), concepts.take(j)], names)

    return with_hashes(arrays).select(*columns).mapInArrow(run, f"doc {doc}, time string, a string, b string")


def counted_pairs(
    arrays: DataFrame, cells: np.ndarray | None = None, concepts: np.ndarray | None = None, always: np.ndarray | None = None, timed: bool = False
) -> DataFrame:
    """``a, b, n``, or ``time, a, b, n`` when ``timed``: pairs counted inside each batch, to be summed by the caller.

    Pairs are those of true ``cells`` and true ``concepts`` cells, where given, and those of two concepts in the concept
    cells ``always``.
    """
    context = arrays.sparkSession.sparkContext
    tables = context.broadcast((cells, concepts, always))
    names = [*(["time"] if timed else []), "a", "b", "n"]
    most = 8_000_000

    def run(batches):
        wanted, known, kept = tables.value
        for batch in batches:
            texts, hashes = batch.column(1).flatten().dictionary_encode(), batch.column(2).flatten().to_numpy()
            word, times = texts.indices.to_numpy().astype(np.int64), batch.column(0).dictionary_encode()
            when, width = times.indices.to_numpy().astype(np.int64) if timed else None, max(1, len(texts.dictionary))
            inside = lambda table: table[pair_cells(hashes, hashes, len(table))]
            ok, both = (None if t is None else inside(t) for t in (known, kept))
            waiting, n = [], 0

            def counted():
                key, count = np.unique(np.concatenate(waiting), return_counts=True)
                ends = [texts.dictionary.take(pa.array(x)) for x in (key // width % width, key % width)]
                first = [times.dictionary.take(pa.array(key // (width * width)))] if timed else []
                return pa.RecordBatch.from_arrays([*first, *ends, pa.array(count, pa.int64())], names)

            for row, i, j in _positions(batch.column(1), batch.column(3)):
                good = np.ones(len(i), bool)
                if wanted is not None:
                    good &= wanted[pair_cells(hashes[i], hashes[j], len(wanted))]
                if ok is not None:
                    good &= ok[i] & ok[j]
                if both is not None:
                    good |= both[i] & both[j]
                key = word[i[good]] * width + word[j[good]]
                waiting.append(key + when[row[good]] * (width * width) if timed else key)
                n += len(key)
                if n > most:
                    yield counted()
                    waiting, n = [], 0
            if n:
                yield counted()

    rows = with_hashes(arrays).select("time", "concepts", "hashes", _cut(arrays).alias("cut"))
    return rows.mapInArrow(run, f"{'time string, ' if timed else ''}a string, b string, n bigint")
