"""Lag regression: samples from count series, one gradient-boosted model shared by all entities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risewatch.operators.core import top_k
from risewatch.operators.series import entity_totals, series_arrays
from risewatch.session import durable


def _mean(x: Column, start: Column, size: int) -> Column:
    """Mean of ``size`` values of the array from zero-based ``start``."""
    return F.aggregate(F.slice(x, start + 1, size), F.lit(0.0), lambda a, v: a + v) / size


def lag_samples(arrays: DataFrame, lag: int = 6, horizon: int = 6) -> DataFrame:
    """One row per entity and bin ``t``: the ``lag`` values before ``t`` and the mean of ``[t, t + horizon)``.

    The label is null where the horizon runs past the series. Rows come from each entity's own array.
    """
    x, n = F.col("x"), F.col("n")
    spots = F.transform(
        F.sequence(F.lit(lag), n - 1),
        lambda t: F.struct(
            t.alias("t"),
            F.slice(x, t - lag + 1, lag).alias("features"),
            F.when(t + horizon <= n, _mean(x, t, horizon)).alias("label"),
        ),
    )
    return arrays.where(n > lag).select("entity", "n", F.inline(spots))


def lag_features(counts: DataFrame, lag: int = 6) -> DataFrame:
    """Wide lag rows ``lag_1 .. lag_k`` (oldest first) per entity and bin position."""
    rows = lag_samples(series_arrays(counts), lag, 1)
    return rows.select("entity", "t", *[F.col("features")[i].alias(f"lag_{i + 1}") for i in range(lag)])


def horizon_label(counts: DataFrame, horizon: int = 6) -> DataFrame:
    """Mean of the next ``horizon`` bins at every position with a full horizon."""
    a = series_arrays(counts)
    spots = F.transform(
        F.sequence(F.lit(0), F.col("n") - horizon),
        lambda t: F.struct(t.alias("t"), _mean(F.col("x"), t, horizon).alias("label")),
    )
    return a.where(F.col("n") >= horizon).select("entity", F.inline(spots))


def purge(samples: DataFrame, t0: Column | int, horizon: int = 6, gap: int = 6) -> DataFrame:
    """Samples whose label ends more than ``gap`` bins before the test start."""
    start = F.lit(t0) if isinstance(t0, int) else t0
    return samples.where(F.col("label").isNotNull() & (F.col("t") + horizon < start - gap))


def _fit_predict(train: DataFrame, test: DataFrame, max_iter: int, seed: int) -> DataFrame:
    vec = lambda df: df.withColumn("fv", array_to_vector(F.col("features")))
    model = GBTRegressor(featuresCol="fv", labelCol="label", weightCol="weight", predictionCol="forecast", maxIter=max_iter, seed=seed)
    # Series of small counts repeat the same few bins: equal samples are one row with their number as its weight.
    times = F.sum("weight") if "weight" in train.columns else F.count(F.lit(1)).cast("double")
    equal = train.groupBy("features", "label").agg(times.alias("weight"))
    rows = durable(vec(equal))
    # Every split of every tree is a job: few rows in many partitions would be all overhead. Places and order follow the values,
    # because split bins are drawn from a sample by position: equal samples give the same model, however they were counted.
    rows = rows.repartition(1 + rows.count() // 50_000, "features", "label").sortWithinPartitions("features", "label")
    return model.fit(rows).transform(vec(test)).drop("fv")


def select_arrays(counts: DataFrame, k: int | None = None, until: int | None = None, arrays: DataFrame | None = None) -> DataFrame:
    """Arrays of every entity, or of the ``k`` most active, by activity before bin position ``until`` when given."""
    arrays = series_arrays(counts) if arrays is None else arrays
    if k is None:
        return arrays
    if until is None:
        keep = top_k(entity_totals(counts), "total", k).select("entity")
    else:
        past = arrays.withColumn("total", F.aggregate(F.slice("x", 1, until), F.lit(0.0), lambda a, v: a + v))
        keep = top_k(past.select("entity", "total"), "total", k).select("entity")
    return arrays.join(keep, "entity", "left_semi")


def forecast(
    counts: DataFrame,
    horizon: int = 6,
    min_history: int = 12,
    k: int | None = None,
    lag: int = 6,
    strict: bool = True,
    max_iter: int = 50,
    seed: int = 42,
) -> DataFrame:
    """Mean of the last ``horizon`` bins forecast for every entity, or the ``k`` most active.

    ``strict`` keeps training labels and the recent mean clear of the test bins; ``strict=False`` lets both
    overlap them.
    """
    arrays = select_arrays(counts, k).where(F.col("n") >= min_history + horizon)
    samples = lag_samples(arrays, lag, horizon)
    cut = F.col("n") - horizon
    train = samples.where(F.col("label").isNotNull() & (F.col("t") < cut))
    if strict:
        train = train.where(F.col("t") + horizon <= cut)
    recent_from = (F.col("n") - horizon - lag) if strict else (F.col("n") - lag)
    test = samples.where(F.col("t") == cut).join(
        arrays.select("entity", _mean(F.col("x"), recent_from, lag).alias("recent_mean")), "entity"
    )
    out = _fit_predict(train, test, max_iter, seed)
    return out.select("entity", "recent_mean", "forecast", F.col("label").alias("actual"))


def regression_fold(
    counts: DataFrame,
    t0: int,
    horizon: int = 6,
    k: int | None = None,
    lag: int = 6,
    gap: int = 6,
    past_only: bool = True,
    max_iter: int = 50,
    seed: int = 42,
    arrays: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train and test samples of one forecast start; entities chosen by activity before it. Stored ``arrays`` are not made again."""
    arrays = select_arrays(counts, k, t0 if past_only else None, arrays)
    samples = lag_samples(arrays, lag, horizon)
    return purge(samples, t0, horizon, gap), samples.where(F.col("t") == t0)


def counted_samples(arrays: DataFrame, starts: Sequence[int], lag: int = 6, horizon: int = 6, gap: int = 6) -> DataFrame:
    """Equal samples of all forecast starts with their number ``weight``, from one pass over the arrays.

    ``fold`` is a position in the ascending ``starts``: for a ``test`` row its own, for a train row the first one whose purge keeps
    it (the later ones keep it too).
    """
    cuts = [t0 - gap - horizon for t0 in starts]  # train bins end before
    # a train spot is its bin, a test spot is -1 - fold
    spots = [*range(lag, max(cuts)), *range(-1, -1 - len(starts), -1)]
    spot, test = F.col("spot"), F.col("spot") < 0
    at = arrays.select("x", F.explode(F.lit(spots)).alias("spot"))
    at = at.select("x", "spot", F.when(test, F.get(F.lit(list(starts)), -1 - spot)).otherwise(spot).alias("t"))
    first = sum((F.when(spot >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    names = [f"lag_{i + 1}" for i in range(lag)]  # grouped as plain numbers: arrays as keys are many times slower
    rows = at.select(
        test.alias("test"),
        F.when(test, -1 - spot).otherwise(first).alias("fold"),
        *[F.get("x", F.col("t") - lag + i).alias(c) for i, c in enumerate(names)],
        reduce(Column.__add__, [F.get("x", F.col("t") + j) for j in range(horizon)]).alias("_sum"),
    )
    return (
        rows.where("_sum is not null")
        .groupBy("test", "fold", *names, "_sum")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
        .select("test", "fold", F.array(*names).alias("features"), (F.col("_sum") / horizon).alias("label"), "weight")
    )


def fit_fold(train: DataFrame, test: DataFrame, max_iter: int = 50, seed: int = 42) -> DataFrame:
    """Forecasts of the test samples; equal ones keep their number ``weight`` where they were counted."""
    kept = [c for c in ("entity", "weight") if c in test.columns]
    return _fit_predict(train, test, max_iter, seed).select(*kept, "forecast", F.col("label").alias("actual"))


