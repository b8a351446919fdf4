"""S-curve stages of cumulative series, from sparse counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from risewatch.operators.core import attach, quantiles
from risewatch.operators.series import bin_axis, indexed
from risewatch.session import durable

STAGES = ("emerging", "growth", "mature", "declining")


def stage_points(counts: DataFrame, growth_window: int = 6, by: Sequence[str] = ()) -> DataFrame:
    """First, pivot and end value of each entity's running total, without building the running total."""
    n, o, c = F.col("n_bins"), F.col("ord"), F.col("cnt")
    w = F.least(F.lit(growth_window), n - 1)
    return (
        indexed(counts, by)
        .groupBy(*by, "entity")
        .agg(
            F.first("n_bins").alias("n"),
            F.sum(F.when(o == 1, c).otherwise(0)).alias("first"),
            F.sum(F.when(o <= n - w, c).otherwise(0)).alias("pivot"),
            F.sum("cnt").alias("total"),
        )
    )


def stage_of(points: DataFrame, min_history: int = 12, threshold: str | None = "threshold") -> DataFrame:
    """Stage rule on ``n, first, pivot, total`` (and an optional small-total threshold column)."""
    recent = F.col("total") - F.col("pivot")
    history = F.col("pivot") - F.col("first")
    small = F.col("total") < F.col(threshold) if threshold else F.lit(False)
    return points.withColumn(
        "stage",
        F.when(F.col("n") < 3, "emerging")
        .when(F.col("total") <= 0, "emerging")
        .when(F.col("n") < min_history, "emerging")
        .when(F.coalesce(small, F.lit(False)), "emerging")
        .when(recent <= 0, "declining")
        .when(history <= 0, "growth")
        .when(recent > history, "growth")
        .otherwise("mature"),
    )


def concept_stages(
    counts: DataFrame,
    growth_window: int = 6,
    emerging_quantile: float = 0.2,
    min_history: int = 12,
    by: Sequence[str] = (),
) -> DataFrame:
    """Stage of every entity; entities below the given quantile of end totals are emerging."""
    points = durable(stage_points(counts, growth_window, by))
    cut = quantiles(points, "total", {"threshold": emerging_quantile}, by).select(*by, "threshold")
    return stage_of(attach(points, cut, by), min_history).select(*by, "entity", "total", "stage")


def stage_curves(counts: DataFrame, stages: DataFrame) -> DataFrame:
    """Mean normalised running total per stage and bin.

    The mean of running totals equals the running total of per-bin sums, so each entity contributes its own
    ``cnt / total`` cells and the result is accumulated over the few ``(stage, bin)`` rows.
    """
    axis = bin_axis(counts).select("bin", "ord")
    sizes = stages.groupBy("stage").agg(F.count(F.lit(1)).alias("size"))
    cells = (
        counts.join(stages.where("total > 0").select("entity", "stage", "total"), "entity")
        .groupBy("stage", "bin")
        .agg(F.sum(F.col("cnt") / F.col("total")).alias("step"))
    )
    bins = axis.agg(F.array_sort(F.collect_list("bin")).alias("_bins"))
    grid = attach(sizes, bins).select("stage", "size", F.explode("_bins").alias("bin"))
    order = F.create_map(*[x for i, s in enumerate(STAGES) for x in (F.lit(s), F.lit(i))])
    run = W.partitionBy("stage").orderBy("bin")
    return (
        grid.join(cells, ["stage", "bin"], "left")
        .select(
            order[F.col("stage")].alias("stage_order"),
            "stage",
            "bin",
            (F.sum(F.coalesce("step", F.lit(0.0))).over(run) / F.col("size")).alias("level"),
        )
    )


def stage_distribution(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
