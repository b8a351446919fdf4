"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted candidate lists.

Every component x becomes ``floor(256 x)``; a row's score for an anchor is their integer inner product. Rows are dealt
by a hash of their id into blocks of at most about ``BLOCK`` rows, anchors into groups of ``GROUP``; one cell meets one
block with one group, its block in memory and its anchors as a stream. Inside a cell each dimension has its rows in
sorted order. An anchor reads all lists at once, from the top where its own component is positive and from the bottom
where it is negative, scores each row it meets for the first time, and stops once the threshold, the best score an
unmet row could have, falls strictly below the k-th score of each of its windows (or below the window). Strictly, for a
row of equal score and smaller id could still be unmet. Two passes: the first finds the positives (over the lists of the
anchor's own label), the second the negatives in the score window of each positive. The best k of all blocks are
merged by score and id.

No label, id or group of copies is a key of a shuffle, so none can be hot. Rows travel once for each group of anchors
and anchors once for each block, as small integers.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows of one id are one vector: the
least (label, vector). Missing components of shorter vectors are 0. Scaled components are held within 2**27, so that
scores fit a long. A window without rows gives none; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from risewatch.llm.common import stored

#: Rows of a block and anchors of a group, about.
BLOCK, GROUP = 1 << 15, 1 << 16
#: Largest scaled component.
LARGEST = 1 << 27
#: Depth of the first access to the sorted lists; it doubles from step to step.
FIRST = 8


def scaled(df: DataFrame, ident: str, label: str, vector: str, scale: int = 256) -> DataFrame:
    """``id``, ``label``, ``vec`` of the rows that take part, as the smallest integers that hold all of them."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x.cast("double") * scale))).cast("int"))
    rows = df.where(F.col(ident).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite)
    return stored(rows.select(F.col(ident).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), whole.alias("vec")), "scaled")


def cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Rows and anchors by cell, rows first; ``anchors`` has the columns of ``rows`` and ``windows``."""
    blocks = max(1, -(-n_rows // BLOCK))
    wanted = max(1, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // blocks))
    groups = max(1, -(-n_anchors // GROUP), min(wanted, n_anchors))
    part = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    near = rows.withColumn("windows", F.lit(None).cast("array<bigint>")).withColumn("block", part(blocks, 1)).withColumn("group", every(groups)).withColumn("kind", F.lit(0))
    far = anchors.withColumn("group", part(groups, 2)).withColumn("block", every(blocks)).withColumn("kind", F.lit(1))
    cell = (F.col("block") * groups + F.col("group")).alias("cell")
    both = near.select(cell, "kind", "id", "label", "vec", "windows").unionByName(far.select(cell, "kind", "id", "label", "vec", "windows"))
    return both.repartition(min(blocks * groups, 20_000), "cell").sortWithinPartitions("cell", "kind", "id")


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of integers as rows of a matrix, padded with 0 (or cut) to ``width``."""
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    widest = int(length.max(initial=0))
    out = np.zeros((len(length), widest), np.int64)
    out[np.arange(widest) < length[:, None]] = flat
    if width is None or width == widest:
        return out
    return out[:, :width] if width < widest else np.pad(out, ((0, 0), (0, width - widest)))


class Lists:
    """Rows of one block with their sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray):
        self.ids, self.labels, self.vecs = ids, labels, vecs
        order = np.argsort(vecs, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T.astype(np.int32))
        self.values = np.ascontiguousarray(np.take_along_axis(vecs, order, axis=0).T)
        self.largest = int(np.abs(vecs).max(initial=0))
        self.exact: dict[type, np.ndarray] = {}

    def number(self, anchor: np.ndarray) -> type:
        """The fastest type in which every partial sum of a score is exact."""
        bound = self.largest * int(np.abs(anchor).sum())
        return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        kind = self.number(anchor)
        if kind not in self.exact:
            self.exact[kind] = self.vecs.astype(kind)
        return (self.exact[kind][rows] @ anchor.astype(kind)).astype(np.int64)

    def meet(self, anchor: np.ndarray, enough):
        """Rows in the order of the threshold algorithm, as (rows, scores); ``enough(threshold)`` ends the access."""
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not n or enough(int(self.values[up, -1] @ anchor[up]) + int(self.values[down, 0] @ anchor[down])):
            return
        met, depth, step = np.zeros(n, bool), 0, FIRST
        if not len(up) and not len(down):
            depth = n
            yield np.arange(n), np.zeros(n, np.int64)
        while depth < n:
            to = min(n, depth + step)
            before = met.copy()
            met[self.order[up, n - to : n - depth].ravel()] = True
            met[self.order[down, depth:to].ravel()] = True
            fresh = np.flatnonzero(met & ~before)
            yield fresh, self.scores(fresh, anchor)
            if enough(int(self.values[up, n - to] @ anchor[up]) + int(self.values[down, to - 1] @ anchor[down])) or met.all():
                return
            depth, step = to, 2 * step


class Best:
    """The first ``k`` rows with low <= score <= high, by score descending and id ascending."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.ids = self.scores = np.zeros(0, np.int64)

    def floor(self) -> int | None:
        """Rows that score below this cannot enter; None while any could."""
        return int(self.scores[-1]) if len(self.ids) == self.k else self.low

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        floor = self.floor()
        good = np.ones(len(ids), bool) if floor is None else scores >= floor
        if self.high is not None:
            good &= scores <= self.high
        if good.any():
            ids, scores = np.concatenate([self.ids, ids[good]]), np.concatenate([self.scores, scores[good]])
            if len(ids) > 4 * self.k:
                edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                ids, scores = ids[scores >= edge], scores[scores >= edge]
            first = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores = ids[first], scores[first]

    def done(self, threshold: int) -> bool:
        floor = self.floor()
        return floor is not None and threshold < floor


def distinct_rows(ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray):
    """One row for each id: the least (label, vector)."""
    if len(np.unique(ids)) == len(ids):
        return ids, labels, vecs
    order = np.lexsort((*vecs.T[::-1], labels, ids))
    order = order[np.append(True, np.diff(ids[order]) != 0)]
    return ids[order], labels[order], vecs[order]


def searched(cell_rows: DataFrame, search, schema: str, names: list[str]) -> DataFrame:
    """``search(block, id, label, vector, windows) -> tuples`` for every anchor of every cell."""

    def run(batches):
        now, gathered, block = None, [], None
        for batch in batches:
            cell, kind, ids, labels = (batch.column(i).to_numpy() for i in range(4))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1
            out = []
            for lo, hi in zip([0, *cuts], [*cuts, len(cell)]):
                if cell[lo] != now:
                    now, gathered, block = cell[lo], [], None
                vecs = batch.column(4).slice(lo, hi - lo)
                if kind[lo] == 0:
                    gathered.append((ids[lo:hi], labels[lo:hi], matrix(vecs)))
                    continue
                if not gathered:
                    continue
                if block is None:
                    width = max(v.shape[1] for _, _, v in gathered)
                    padded = [np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, _, v in gathered]
                    block = {"all": Lists(*distinct_rows(np.concatenate([x[0] for x in gathered]), np.concatenate([x[1] for x in gathered]), np.concatenate(padded)))}
                    gathered = [True]
                windows = batch.column(5).slice(lo, hi - lo).to_pylist()
                for row in zip(ids[lo:hi].tolist(), labels[lo:hi].tolist(), matrix(vecs, block["all"].vecs.shape[1]), windows):
                    out += search(block, *row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names)

    return cell_rows.mapInArrow(run, schema)


def first(df: DataFrame, by: list[str], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` of each group over all blocks."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.asc("id")))).where(F.col(name) <= k)


def mine(df: DataFrame, ident: str, label: str, vector: str, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each row that ``anchor`` (over ``id``) takes and each of its first ``positives`` rows of the same label: the first
    ``negatives`` rows of other labels with ``low * positive_score <= 100 * score <= high * positive_score``.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = scaled(df, ident, label, vector)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(anchor).alias("a"), F.max(F.array_max(F.transform("vec", F.abs))).alias("x")).first()
    if (size["x"] or 0) < 1 << 15:
        rows = rows.withColumn("vec", F.col("vec").cast("array<smallint>"))
    chosen = rows.where(anchor).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row")).select("id", "row.label", "row.vec")
    counts = (size["n"], size["a"])

    def nearest(block, ident, label, vec, _):
        lists = block.get(label)
        if lists is None:
            whole = block["all"]
            mine = whole.labels == label
            lists = block[label] = Lists(whole.ids[mine], whole.labels[mine], whole.vecs[mine])
        best = Best(positives)
        for at, scores in lists.meet(vec, best.done):
            other = lists.ids[at] != ident
            best.offer(lists.ids[at][other], scores[other])
        return [(ident, a, s) for a, s in zip(best.ids.tolist(), best.scores.tolist())]

    found = searched(cells(rows, chosen.withColumn("windows", F.lit(None).cast("array<bigint>")), *counts), nearest, "anchor bigint, id bigint, score bigint", ["anchor", "id", "score"])
    pairs = stored(first(found, ["anchor"], positives).select("anchor", F.col("id").alias("positive"), F.col("score").alias("p_score")), "positives")
    windows = pairs.groupBy("anchor").agg(F.sort_array(F.collect_set("p_score")).alias("windows"))  # at most `positives` values

    def hardest(block, ident, label, vec, windows):
        whole = block["all"]
        best = {s: Best(negatives, -(-low * s // 100), high * s // 100) for s in windows if low * s <= high * s}
        if not best:
            return []
        for at, scores in whole.meet(vec, lambda threshold: all(b.done(threshold) for b in best.values())):
            good = (whole.labels[at] != label) & (scores >= min(b.floor() for b in best.values()))
            at, scores = at[good], scores[good]
            for b in best.values():
                b.offer(whole.ids[at], scores)
        return [(ident, s, a, x) for s, b in best.items() for a, x in zip(b.ids.tolist(), b.scores.tolist())]

    asked = chosen.join(windows, chosen["id"] == windows["anchor"]).drop("anchor")
    found = searched(cells(rows, asked, *counts), hardest, "anchor bigint, p_score bigint, id bigint, score bigint", ["anchor", "p_score", "id", "score"])
    ranked = first(found, ["anchor", "p_score"], negatives)
    return pairs.join(ranked, ["anchor", "p_score"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score")
    )
