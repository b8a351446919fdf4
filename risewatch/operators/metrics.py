"""Ranking, link and regression metrics as one-row (or one row per ``by``) tables.

``ranked`` has ``entity, pos`` (1 = best); ``truth`` has ``entity``; ``relevance`` has ``entity, rel``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risewatch.operators.core import attach, global_rank, top_k


def _agg(df: DataFrame, by: Sequence[str], *cols: Column) -> DataFrame:
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def precision_recall(ranked: DataFrame, truth: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Hits of the first ``k`` over the list length (it may be shorter than k) and over the truth size."""
    by = list(by)
    top = ranked.where(F.col("pos") <= k).select(*by, "entity").distinct()
    flags = top.withColumn("_r", F.lit(1)).join(
        truth.select(*by, "entity").distinct().withColumn("_t", F.lit(1)), [*by, "entity"], "full"
    )
    hits, n_top, n_truth = F.count_if(F.col("_r").isNotNull() & F.col("_t").isNotNull()), F.count("_r"), F.count("_t")
    return _agg(
        flags,
        by,
        F.when(n_top > 0, hits / n_top).otherwise(0.0).alias("precision_at_k"),
        F.when(n_truth > 0, hits / n_truth).otherwise(0.0).alias("recall_at_k"),
    )


def precision_at_k(ranked: DataFrame, truth: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    return precision_recall(ranked, truth, k, by).drop("recall_at_k")


def recall_at_k(ranked: DataFrame, truth: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    return precision_recall(ranked, truth, k, by).drop("precision_at_k")


def mrr(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _agg(ranks, by, F.coalesce(F.avg(1.0 / F.col("rank")), F.lit(0.0)).alias("mrr"))


def hits_at(ranks: DataFrame, ks: Sequence[int] = (1, 3, 10), by: Sequence[str] = ()) -> DataFrame:
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return _agg(ranks, by, *[F.coalesce(hit(k), F.lit(0.0)).alias(f"hits_at_{k}") for k in ks])


def regression_errors(
    df: DataFrame, actual: str = "actual", pred: str = "forecast", by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """MAE, RMSE and MAPE; zero actuals are left out of MAPE, empty input gives 0. A row counts ``weight`` times."""
    a, p = F.col(actual), F.col(pred)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    mean = lambda c: F.try_divide(F.sum(c * F.col(weight)), F.sum(F.when(c.isNotNull(), F.col(weight)))) if weight else F.avg(c)
    return _agg(
        df,
        by,
        zero(mean(F.abs(a - p))).alias("mae"),
        zero(F.sqrt(mean((a - p) * (a - p)))).alias("rmse"),
        zero(mean(F.when(a != 0, F.abs(a - p) / F.abs(a)))).alias("mape"),
    )


def spearman(pred: DataFrame, true: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``1 - 6 sum d^2 / (n (n^2 - 1))`` on ordinal ranks (ties by id) over the common entities.

    Both inputs have ``entity, score``. Ranks come from range-partitioned numbering, not a one-task sort.
    """
    by = list(by)
    both = pred.select(*by, "entity", F.col("score").alias("_p")).join(
        true.select(*by, "entity", F.col("score").alias("_t")), [*by, "entity"]
    )
    first = global_rank(both, [F.desc("_p"), F.asc("entity")], by, "_rp")
    second = global_rank(first, [F.desc("_t"), F.asc("entity")], by, "_rt")
    d = F.col("_rp") - F.col("_rt")
    n = F.count(F.lit(1)).cast("double")
    rho = F.when(n < 2, 0.0).otherwise(1.0 - 6.0 * F.sum(d * d) / (n * (n * n - 1)))
    return _agg(second, by, rho.alias("spearman_rho"))


def ndcg_at_k(ranked: DataFrame, relevance: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Discounted gain ``2^rel - 1`` of the first ``k`` over the best possible order.

    Both sums are taken in units of ``2^max``, so that any relevance fits: the ratio is that of the plain gains.
    """
    by = list(by)
    cut = _agg(ranked, by, F.least(F.lit(k), F.count(F.lit(1))).alias("_k"))
    top = relevance.groupBy(*by).agg(F.max("rel").alias("_max")) if by else relevance.agg(F.max("rel").alias("_max"))
    top = top.withColumn("_max", F.greatest(F.coalesce("_max", F.lit(0.0)), F.lit(0.0)))
    rel = F.greatest(F.coalesce("rel", F.lit(0.0)), F.lit(0.0))
    gain = F.pow(F.lit(2.0), rel - F.col("_max")) - F.pow(F.lit(2.0), -F.col("_max"))
    discounted = gain / F.log2(F.col("pos") + 1.0)
    got = ranked.where(F.col("pos") <= k).join(relevance, [*by, "entity"], "left")
    dcg = _agg(attach(got, top, by), by, F.sum(discounted).alias("_dcg"))
    ideal = attach(attach(top_k(relevance, "rel", k, by), cut, by).where(F.col("pos") <= F.col("_k")), top, by)
    idcg = _agg(ideal, by, F.sum(discounted).alias("_idcg"), F.max("_max").alias("_unit"))
    both = dcg.join(idcg, by, "full") if by else attach(dcg, idcg)
    d, i = F.coalesce("_dcg", F.lit(0.0)), F.coalesce("_idcg", F.lit(0.0))
    unit = F.pow(F.lit(2.0), F.least(F.coalesce("_unit", F.lit(0.0)), F.lit(1000.0)))
    return both.select(
        *by, F.when(i * unit <= 1e-9, F.when(d * unit <= 1e-9, 1.0).otherwise(0.0)).otherwise(d / i).alias(f"ndcg_at_{k}")
    )


def top1_lift(ranked: DataFrame, relevance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Relevance of the first entry over the mean of the list; null when the mean is not positive."""
    by = list(by)
    rows = ranked.join(relevance, [*by, "entity"], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))
    mean = F.avg("rel")
    first = F.max(F.when(F.col("pos") == 1, F.col("rel")))
    return _agg(rows, by, F.when(mean > 0, first / mean).alias("top1_lift"))


def aggregate_folds(folds: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each metric over the folds that have it, and the fold count."""
    cols = [x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    return folds.agg(F.count(F.lit(1)).alias("n_folds"), *cols)


def rank_positions(df: DataFrame, score: str) -> DataFrame:
    """Whole table in score order with ``pos``, for lists too long for a top-k."""
    return global_rank(df, [F.desc(score), F.asc("entity")], name="pos")

