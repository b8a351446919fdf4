"""Generate mode: low-rank factors of the edge counts, blended with the copy history.

Scores are computed head block against entity block inside tasks; only per-head sums, per-entity sums and per-query
counts leave a task, never the head x entity grid. A head block travels once for each entity block, so what is moved
grows with heads x entities / ``BLOCK``. Every function takes ``by`` columns (folds): one job for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from risewatch.operators.core import occurrences
from risewatch.operators.factors import group_key
from risewatch.operators.graph import encode_entities
from risewatch.operators.links import copy_history, known_tails
from risewatch.session import durable

BLOCK = 2048
EPS = 1e-9  # logits closer than this are ties


def fit_generate(train: DataFrame, dim: int = 32, seed: int = 42, max_iter: int = 10) -> tuple[DataFrame, DataFrame]:
    """Head factors and entity factors as ``(entity, vec)`` tables (implicit-feedback ALS on edge counts)."""
    ids = durable(encode_entities(train))
    h = ids.toDF("head", "h")
    t = ids.toDF("tail", "t")
    counts = train.groupBy("head", "tail").agg(F.count(F.lit(1)).cast("float").alias("c"))
    rows = counts.join(h, "head").join(t, "tail").select(F.col("h").cast("int"), F.col("t").cast("int"), "c")
    model = ALS(
        rank=dim, maxIter=max_iter, implicitPrefs=True, userCol="h", itemCol="t", ratingCol="c", seed=seed
    ).fit(rows)

    def named(factors: DataFrame) -> DataFrame:
        zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
        f = factors.select(F.col("id").cast("bigint").alias("entity_id"), F.col("features").alias("vec"))
        return ids.join(f, "entity_id", "left").select("entity", F.coalesce("vec", zero).alias("vec"))

    return named(model.userFactors), named(model.itemFactors)


def _blocks(rows: DataFrame, name: str, *columns: str, weight: str | None = None) -> DataFrame:
    """Rows of every group cut by hash into blocks of about ``BLOCK`` rows, or of sixteen times that weight."""
    size = F.ceil(F.count(F.lit(1)) / BLOCK)
    if weight:
        size = F.greatest(size, F.ceil(F.sum(weight) / (16 * BLOCK)))
    n = rows.groupBy("_g").agg(size.alias("_n"))  # one row for each fold
    return (
        rows.join(F.broadcast(n), "_g")
        .withColumn(name, F.pmod(F.xxhash64(*columns[:1]), F.col("_n")))
        .groupBy("_g", name, "_n")
        .agg(F.collect_list(F.struct(*columns)).alias("rows"))
    )


def _pairs(heads: DataFrame, items: DataFrame) -> DataFrame:
    """Each head block meets each entity block of its group once, by an equi-join on the entity block number."""
    i = durable(_blocks(items, "_i", "entity", "vec"))
    width = i.groupBy("_g").agg(F.max("_n").alias("_w"))
    h = heads.join(F.broadcast(width), "_g").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_w") - 1)))
    return h.select("_g", "_i", F.col("rows").alias("heads")).join(i.select("_g", "_i", F.col("rows").alias("items")), ["_g", "_i"]).select("_g", "heads", "items")


def _matrix(rows: list) -> np.ndarray:
    return np.array([r["vec"] for r in rows], dtype=np.float64)


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for g, heads, items in zip(pdf["_g"], pdf["heads"], pdf["items"]):
            logits = _matrix(heads) @ _matrix(items).T
            top = logits.max(axis=1)
            yield pd.DataFrame(
                {"_g": g, "head": [r["entity"] for r in heads], "top": top, "mass": np.exp(logits - top[:, None]).sum(axis=1)}
            )


def _keyed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.withColumn("_g", group_key(by))


def _log_z(heads: DataFrame, items: DataFrame) -> DataFrame:
    parts = durable(_pairs(_blocks(heads, "_h", "entity", "vec"), items).mapInPandas(_partial_sums, "_g string, head string, top double, mass double"))
    peak = parts.groupBy("_g", "head").agg(F.max("top").alias("peak"))
    return (
        parts.join(peak, ["_g", "head"])
        .groupBy("_g", "head", "peak")
        .agg(F.sum(F.col("mass") * F.exp(F.col("top") - F.col("peak"))).alias("z"))
        .select("_g", "head", (F.col("peak") + F.log("z")).alias("log_z"))
    )


def log_partition(heads: DataFrame, items: DataFrame) -> DataFrame:
    """``log sum exp`` of every head over all entities."""
    return _log_z(_keyed(heads, ()), _keyed(items, ())).drop("_g")


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def blend_scores(
    queries: DataFrame, train: DataFrame, factors: tuple[DataFrame, DataFrame], alpha: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """``alpha * copy share + (1 - alpha) * softmax`` of each queried edge; unknown ends are dropped."""
    by = list(by)
    users, items = (_keyed(f, by) for f in factors)
    edge = [*by, "head", "relation", "tail"]
    q = _keyed(queries.select(*edge).distinct(), by)
    heads = durable(users.join(q.select("_g", F.col("head").alias("entity")).distinct(), ["_g", "entity"], "left_semi").select("_g", "entity", "vec"))
    z = _log_z(heads, items)
    rows = (
        q.join(heads.toDF("_g", "head", "u"), ["_g", "head"])
        .join(items.select("_g", F.col("entity").alias("tail"), F.col("vec").alias("v")), ["_g", "tail"])
        .join(z, ["_g", "head"])
        .join(copy_history(train, by).select(*edge, "share"), edge, "left")
    )
    logit = _dot("u", "v")
    return rows.select(
        *edge,
        logit.alias("logit"),
        "log_z",
        (alpha * F.coalesce("share", F.lit(0.0)) + (1 - alpha) * F.exp(logit - F.col("log_z"))).alias("score"),
    )


def _above(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For the bars of a block's heads: entities of the block above, and tied with, each bar."""
    for pdf in batches:
        for g, heads, items in zip(pdf["_g"], pdf["heads"], pdf["items"]):
            logits = np.sort(_matrix(heads) @ _matrix(items).T, axis=1)
            width = [len(r["bars"]) for r in heads]
            bars = np.concatenate([np.asarray(r["bars"], dtype=np.float64) for r in heads])
            ends = np.cumsum(width)
            upto, below = np.empty(len(bars), np.int64), np.empty(len(bars), np.int64)
            for row, lo, hi in zip(logits, ends - width, ends):
                upto[lo:hi] = np.searchsorted(row, bars[lo:hi] + EPS, side="right")
                below[lo:hi] = np.searchsorted(row, bars[lo:hi] - EPS, side="right")
            names = np.repeat(np.array([r["entity"] for r in heads], dtype=object), width)
            yield pd.DataFrame({"_g": g, "head": names, "bar": bars, "n": logits.shape[1] - upto, "tie": upto - below})


def blend_ranks(
    test: DataFrame, train: DataFrame, factors: tuple[DataFrame, DataFrame], alpha: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """Filtered rank of each known test edge under the blended score, known tails being train and test.

    Every copied tail is a known tail, so the remaining competitors carry the softmax part only. A query is a bar on its
    head's logits. Blocks of heads with all their bars meet blocks of entities; the counts above each bar are added over
    the entity blocks, and the known tails among them are taken out by an ordered running count per head.
    """
    by = list(by)
    users, items = (_keyed(f, by).select("_g", "entity", "vec") for f in factors)
    edge = [*by, "head", "relation", "tail"]
    scored = durable(
        _keyed(blend_scores(test, train, factors, alpha, by), by).withColumn("bar", F.log(F.col("score") / (1 - alpha)) + F.col("log_z"))
    )
    levels = scored.select("_g", "head", "bar").distinct()
    # A head with very many bars is several rows, each with a bounded list.
    asked = levels.groupBy("_g", "head").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts"))
    bars = (
        levels.join(asked, ["_g", "head"])
        .groupBy("_g", F.col("head").alias("entity"), F.pmod(F.xxhash64("bar"), F.col("_parts")).alias("_part"))
        .agg(F.array_sort(F.collect_list("bar")).alias("bars"))
    )
    heads = users.join(bars, ["_g", "entity"]).withColumn("_weight", F.size("bars"))
    blocks = _blocks(heads.withColumn("_key", F.struct("entity", "_part")), "_h", "_key", "entity", "vec", "bars", weight="_weight")
    counted = _pairs(blocks, items).mapInPandas(_above, "_g string, head string, bar double, n long, tie long")
    counted = counted.groupBy("_g", "head", "bar").agg(F.sum("n").alias("above_all"), F.sum("tie").alias("tie_all"))
    known = _keyed(known_tails(train.select(*edge).unionByName(test.select(*edge)), by), by)
    logits = (
        known.join(users.toDF("_g", "head", "u"), ["_g", "head"]).join(items.toDF("_g", "tail", "v"), ["_g", "tail"])
        .select("_g", "head", "relation", "tail", _dot("u", "v").alias("logit"))
    )
    # One ladder per (head, relation): known logits and query bars in order, running count of the known ones.
    marks = scored.select("_g", "head", "relation", F.explode(F.array(F.col("bar") + EPS, F.col("bar") - EPS)).alias("at"))
    steps = (
        logits.select("_g", "head", "relation", F.col("logit").alias("at"), F.lit(1).alias("k"))
        .unionByName(marks.withColumn("k", F.lit(0)))
        .groupBy("_g", "head", "relation", "at")
        .agg(F.sum("k").alias("k"))
    )
    line = ["_g", "head", "relation"]
    higher = W.partitionBy(*line).orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1)
    ladder = steps.select(*line, "at", F.coalesce(F.sum("k").over(higher), F.lit(0)).alias("known"))
    placed = (
        scored.join(counted, ["_g", "head", "bar"])
        .withColumns({"hi": F.col("bar") + EPS, "lo": F.col("bar") - EPS})
        .join(ladder.toDF(*line, "hi", "known_hi"), [*line, "hi"])
        .join(ladder.toDF(*line, "lo", "known_lo"), [*line, "lo"])
    )
    others = F.col("tie_all") - (F.col("known_lo") - F.col("known_hi"))
    weights = test.groupBy(*edge).agg(occurrences(test).alias("times"))
    return placed.join(weights, edge).select(
        *edge, "times", "score", (F.col("above_all") - F.col("known_hi") + 1 + others / 2).alias("rank")
    )


def _column_mass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Softmax shares that a block of heads gives to each entity of a block, summed over the heads."""
    for pdf in batches:
        for g, heads, items in zip(pdf["_g"], pdf["heads"], pdf["items"]):
            z = np.array([r["log_z"] for r in heads], dtype=np.float64)
            mass = np.exp(_matrix(heads) @ _matrix(items).T - z[:, None]).sum(axis=0)
            yield pd.DataFrame({"_g": g, "entity": [r["entity"] for r in items], "mass": mass})


def future_link_scores(
    history: DataFrame,
    test: DataFrame,
    factors: tuple[DataFrame, DataFrame],
    relation: str | None = None,
    alpha: float = 0.5,
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean blended score of every entity over the distinct test heads among the entities: ``by…, entity, score``.

    The mean of the softmax part is a column sum: one pass for each head's normaliser, one for the sums over head
    blocks. The copy part is the sum of shares, zero for pairs never seen.
    """
    by = list(by)
    users, items = (_keyed(f, by) for f in factors)
    wanted = _keyed(test, by).select("_g", F.col("head").alias("entity")).distinct()
    heads = durable(users.select("_g", "entity", "vec").join(wanted, ["_g", "entity"], "left_semi"))
    ready = heads.join(_log_z(heads, items).withColumnRenamed("head", "entity"), ["_g", "entity"])
    mass = (
        _pairs(_blocks(ready, "_h", "entity", "vec", "log_z"), items)
        .mapInPandas(_column_mass, "_g string, entity string, mass double")
        .groupBy("_g", "entity")
        .agg(F.sum("mass").alias("_m"))
    )
    rows = history if relation is None else history.where(F.col("relation") == relation)
    copied = (
        _keyed(rows, by).join(heads.select("_g", F.col("entity").alias("head")), ["_g", "head"], "left_semi")
        .groupBy("_g", F.col("tail").alias("entity"))
        .agg(F.sum("share").alias("_s"))
    )
    asked = heads.groupBy("_g").agg(F.count(F.lit(1)).alias("_h"))  # one row for each fold; none where no head is known
    score = (alpha * F.coalesce("_s", F.lit(0.0)) + (1 - alpha) * F.col("_m")) / F.col("_h")
    return (
        items.select(*by, "_g", "entity").join(F.broadcast(asked), "_g").join(mass, ["_g", "entity"]).join(copied, ["_g", "entity"], "left")
        .select(*by, "entity", score.alias("score"))
    )
