"""Walk-forward evaluation. All folds run in one job: ``fold`` is part of every key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from risewatch.functions.dates import month_add
from risewatch.operators import citations, generate, lifecycle, links, metrics, series
from risewatch.operators import forecast as F_
from risewatch.operators.bursts import burst_topk
from risewatch.operators.core import occurrences, small, top_k
from risewatch.operators.factors import fit_factors
from risewatch.operators.series import bin_axis, share_momentum
from risewatch.session import durable


def rolling_origins(facts: DataFrame, n_splits: int = 5, test_months: int = 1, step_months: int = 1, col: str = "time") -> DataFrame:
    """Test windows ``[test_start, test_end)`` stepping back from the month after the last one; ``n_splits`` rows."""
    last = facts.agg(F.max(F.substring(col, 1, 7)).alias("_last")).where("_last <> ''")
    i = F.col("fold")
    end = month_add(F.col("_last"), 1 - (n_splits - 1 - i) * step_months)
    return (
        last.select("_last", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
        .withColumn("test_end", end)
        .select("fold", month_add(F.col("test_end"), -test_months).alias("test_start"), "test_end")
    )


def walk_forward(
    facts: DataFrame, origins: DataFrame, embargo: int = 1, mode: str = "expanding", window: int = 24
) -> DataFrame:
    """Facts with ``fold`` and ``role``; a fact joins every fold that uses it.

    The origins are a handful of rows, so the range join is a broadcast with one pass over the facts.
    """
    m = F.substring(F.coalesce("time", F.lit("")), 1, 7)
    o = origins.select(
        "fold",
        "test_start",
        "test_end",
        month_add(F.col("test_start"), -embargo).alias("_cut"),
        (month_add(F.col("test_start"), -window) if mode == "rolling" else F.lit("")).alias("_from"),
    )
    is_test = (F.col("_m") >= F.col("test_start")) & (F.col("_m") < F.col("test_end"))
    is_train = (F.col("_m") < F.col("_cut")) & (F.col("_m") >= F.col("_from"))
    return (
        facts.withColumn("_m", m)
        .where("_m <> ''")
        .join(F.broadcast(o), is_test | is_train)
        .withColumn("role", F.when(is_test, "test").otherwise("train"))
        .drop("_m", "_cut", "_from", "test_start", "test_end")
    )


def leak_check(folds: DataFrame) -> DataFrame:
    """Per fold: last train month, first test month, violation flag, sizes, entities seen only in test."""
    m = F.substring("time", 1, 7)
    train, test = F.col("role") == "train", F.col("role") == "test"
    spans = folds.groupBy("fold").agg(
        F.max(F.when(train, m)).alias("max_train_month"),
        F.min(F.when(test, m)).alias("min_test_month"),
        F.count_if(train).alias("n_train"),
        F.count_if(test).alias("n_test"),
    )
    ends = folds.select("fold", "role", F.explode(F.array("head", "tail")).alias("entity"))
    per_entity = ends.groupBy("fold", "entity").agg(
        F.max(train.cast("int")).alias("_tr"), F.max(test.cast("int")).alias("_te")
    )
    entities = per_entity.groupBy("fold").agg(
        F.sum("_te").alias("test_entities"), F.count_if((F.col("_te") == 1) & (F.col("_tr") == 0)).alias("test_only_entities")
    )
    return spans.join(entities, "fold").withColumn(
        "violation", F.coalesce(F.col("max_train_month") >= F.col("min_test_month"), F.lit(False))
    )


def _per_fold(counts: DataFrame, origins: DataFrame) -> DataFrame:
    """Counts repeated for each of the few folds; entities keep their later rows so none is lost."""
    windows = origins.agg(F.collect_list(F.struct("fold", "test_start", "test_end"))).scalar()
    return counts.withColumn("_o", windows).select("entity", "bin", "cnt", F.inline("_o"))


def backtest_ranking(
    counts: DataFrame,
    n_splits: int = 5,
    test_months: int = 1,
    step_months: int = 1,
    k: int = 10,
    s: float = 2.0,
    gamma: float = 1.0,
) -> DataFrame:
    """Share-momentum and burst rankings against later growth and activity, one row per fold."""
    by = ["fold"]
    origins = durable(rolling_origins(counts, n_splits, test_months, step_months, "bin"))
    rows = _per_fold(counts, origins)
    hist, fut = F.col("bin") < F.col("test_start"), (F.col("bin") >= F.col("test_start")) & (F.col("bin") < F.col("test_end"))
    shape = (
        bin_axis(rows.select("fold", "entity", "bin", "cnt"), by)
        .join(F.broadcast(origins), "fold")
        .withColumn("n", F.sum(F.when(hist, 1).otherwise(0)).over(W.partitionBy("fold")))
        .withColumn("m", F.sum(F.when(fut, 1).otherwise(0)).over(W.partitionBy("fold")))
        .where("n > 0 and m > 0")
    )
    axis = durable(shape.select("fold", "bin", "bin_total", "ord", "n_bins", "n", "m"))
    base = rows.select("fold", "entity", "bin", "cnt")
    scores = durable(share_momentum(base, by, axis=axis.drop("m")))
    ranked = durable(top_k(scores, "score", k, by))
    hist_axis = axis.withColumn("n_bins", F.col("n")).drop("n", "m")
    bursts = burst_topk(base, k, s, gamma, by=by, axis=hist_axis)
    future = (
        base.join(small(axis), ["fold", "bin"])
        .groupBy("fold", "entity")
        .agg(
            (
                F.sum(F.when(F.col("ord") > F.col("n"), F.when(F.col("ord") <= F.col("n") + F.col("m"), F.col("cnt"))).otherwise(0))
                / F.first("m")
            ).alias("rel"),
            (F.sum(F.when(F.col("ord") <= F.col("n"), F.col("cnt")).otherwise(0)) / F.first("n")).alias("past"),
        )
        .withColumn("rel", F.coalesce("rel", F.lit(0.0)))
    )
    future = durable(future)  # one row per fold and entity, read by every metric below
    truth = top_k(future.withColumn("growth", F.col("rel") - F.col("past")), "growth", k, by)
    relevance = future.select("fold", "entity", "rel")
    pr = metrics.precision_recall(ranked, truth, k, by).toDF("fold", "p_at_k", "r_at_k")
    kpr = metrics.precision_recall(bursts, truth, k, by).toDF("fold", "burst_p_at_k", "burst_r_at_k")
    rho = metrics.spearman(scores, relevance.withColumnRenamed("rel", "score"), by)
    out = pr
    for part in (
        metrics.ndcg_at_k(ranked, relevance, 3, by),
        metrics.ndcg_at_k(ranked, relevance, 5, by),
        rho,
        metrics.top1_lift(ranked, relevance, by),
        kpr,
        axis.groupBy("fold").agg(F.max("n").alias("n_hist_bins"), F.max("m").alias("n_test_bins")),
    ):
        out = out.join(part, "fold", "left")
    return out.join(origins.select("fold", "test_start"), "fold")


RANK_METRICS = (
    "p_at_k", "r_at_k", "ndcg_at_3", "ndcg_at_5", "spearman_rho", "top1_lift", "burst_p_at_k", "burst_r_at_k",
)


def backtest_links(
    facts: DataFrame,
    n_splits: int = 5,
    test_months: int = 1,
    step_months: int = 1,
    embargo: int = 1,
    mode: str = "expanding",
    window: int = 24,
    min_train: int = 200,
) -> DataFrame:
    """Copy-only filtered metrics per fold; folds with too little train or no test are left out."""
    sizes, train, test = _link_folds(facts, n_splits, test_months, step_months, embargo, mode, window, min_train)
    return sizes.join(links.evaluate_copy_only(train, test, by=["fold"]), "fold", "left")


def backtest_blended_links(
    facts: DataFrame,
    n_splits: int = 5,
    test_months: int = 1,
    step_months: int = 1,
    embargo: int = 1,
    mode: str = "expanding",
    window: int = 24,
    min_train: int = 200,
    alpha: float = 0.5,
    dim: int = 16,
    max_iter: int = 5,
) -> DataFrame:
    """Filtered metrics of the blended link model beside copy-only ones, one row per fold.

    The factors of all folds are fitted in one job, ``fold`` being part of every key.
    """
    by = ["fold"]
    sizes, train, test = _link_folds(facts, n_splits, test_months, step_months, embargo, mode, window, min_train)
    edge = ["fold", "head", "relation", "tail"]
    train, test = (durable(f.groupBy(*edge).agg(occurrences(f).alias("n"))) for f in (train, test))
    pair = tuple(durable(f) for f in fit_factors(train, by, dim, max_iter=max_iter))
    ranks = generate.blend_ranks(links.known_queries(test, train, by), train, pair, alpha, by)
    named = lambda df, p: df.select("fold", *[F.col(c).alias(f"{p}_{c}") for c in ("mrr", "hits_at_1", "hits_at_3", "hits_at_10")])
    blended, copied = links.rank_metrics(ranks, by), links.evaluate_copy_only(train, test, by=by)
    return sizes.join(named(blended, "blended"), "fold", "left").join(named(copied, "copy"), "fold", "left")


def _link_folds(facts: DataFrame, n_splits, test_months, step_months, embargo, mode, window, min_train) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes and span of every fold in use, and its train and test facts; counted facts weigh their ``n``."""
    n = F.col("n") if "n" in facts.columns else F.lit(1)
    folds = walk_forward(facts, rolling_origins(facts, n_splits, test_months, step_months), embargo, mode, window)
    m = F.substring("time", 1, 7)
    train, test = F.col("role") == "train", F.col("role") == "test"
    sizes = (
        folds.groupBy("fold")
        .agg(
            F.sum(F.when(train, n).otherwise(0)).alias("n_train"),
            F.sum(F.when(test, n).otherwise(0)).alias("n_test"),
            F.max(F.when(train, m)).alias("train_end"),
            F.min(F.when(test, m)).alias("test_start"),
            F.max(F.when(test, m)).alias("test_end"),
        )
        .where((F.col("n_train") >= min_train) & (F.col("n_test") > 0))
    )
    sizes = durable(sizes)
    used = folds.join(F.broadcast(sizes.select("fold")), "fold", "left_semi")
    return sizes, used.where(train), used.where(test)


def backtest_links_with_fallback(facts: DataFrame, fallback: DataFrame, edge_source: str = "directed", **options):
    """Metrics on the chosen edges, or on the fallback edges when no fold has a metric; returns rows and reason."""
    first = backtest_links(facts, **options)
    if first.where("mrr is not null").limit(1).count():
        return first, edge_source, None
    reason = f"no valid walk-forward fold on {edge_source} edges, evaluated on co-occurrence edges"
    return backtest_links(fallback, **options), "cooccur", reason


def regression_origins(axis: DataFrame, horizon: int = 6, n_splits: int = 5, step: int = 1) -> DataFrame:
    """Ordinals (from 0) of the forecast starts: the last full horizon, then stepping back; ascending folds."""
    step = max(1, step)
    n = axis.agg(F.max("n_bins").alias("n_bins"))
    starts = F.transform(
        F.sequence(F.lit(n_splits - 1), F.lit(0), F.lit(-1)), lambda i: F.col("n_bins") - horizon - i * step
    )
    kept = F.filter(starts, lambda t: t >= 0)
    return n.select("n_bins", F.posexplode(kept).alias("fold", "t0"))


def backtest_regression(
    counts: DataFrame,
    horizon: int = 6,
    min_history: int = 12,
    k: int | None = None,
    lag: int = 6,
    gap: int = 6,
    n_splits: int = 5,
    step: int = 1,
    max_iter: int = 50,
    past_only: bool = True,
    arrays: DataFrame | None = None,
) -> DataFrame:
    """MAE, RMSE and MAPE per forecast start. One model is fitted per fold, so the few folds run in turn.

    The samples of all folds are counted in one pass over the ``arrays``, by default those of the counts; with ``k`` every fold
    has entities and a pass of its own.
    """
    origins = regression_origins(bin_axis(counts), horizon, n_splits, step).collect()  # n_splits rows
    origins = [
        o for o in origins if o["n_bins"] >= min_history + horizon and o["t0"] + horizon <= o["n_bins"] and o["t0"] >= lag
    ]
    arrays = series.series_arrays(counts) if arrays is None else arrays
    arrays = arrays if k is None else durable(arrays)
    out: DataFrame | None = None
    for group in [origins] if k is None else [[o] for o in origins]:
        starts = [o["t0"] for o in group]
        if not starts:
            continue
        chosen = F_.select_arrays(counts, k, starts[0] if past_only else None, arrays)
        samples = durable(F_.counted_samples(chosen, starts, lag, horizon, gap))
        for i, o in enumerate(group):
            train = samples.where(~F.col("test") & (F.col("fold") <= i))
            if (train.agg(F.sum("weight")).first()[0] or 0) < 2:
                continue
            pred = F_.fit_fold(train, samples.where(F.col("test") & (F.col("fold") == i)), max_iter)
            row = metrics.regression_errors(pred, weight="weight").select(
                F.lit(o["fold"]).alias("fold"), F.lit(o["t0"]).alias("t0"), "mae", "rmse", "mape"
            )
            out = row if out is None else out.unionByName(row)
    if out is None:
        return counts.sparkSession.createDataFrame([], "fold int, t0 int, mae double, rmse double, mape double")
    return out


def citation_stages(facts: DataFrame, **sampling) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stages, stage curves and the stored counts of every patent cited often enough."""
    kept = durable(citations.kept_counts(facts, **sampling))
    stages = durable(lifecycle.concept_stages(kept))
    return stages, lifecycle.stage_curves(kept, stages), kept


def citation_report(facts: DataFrame, horizon: int = 6, max_iter: int = 50, **sampling):
    """Cumulative citation series: regression folds when the span allows, stages and stage curves."""
    stages, curves, kept = citation_stages(facts, **sampling)
    bins = bin_axis(kept).count()  # calendar bins
    folds = None
    if bins >= horizon + 2:
        folds = backtest_regression(kept, horizon=horizon, max_iter=max_iter, arrays=series.running_arrays(kept))
    return folds, stages, curves


def citation_report_rows(facts: DataFrame, **settings) -> DataFrame:
    """The citation report as one table: ``part`` names regression folds and points of the stage curves."""
    folds, _, curves = citation_report(facts, **settings)
    out = curves.select(
        F.lit("curve").alias("part"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("fold", "int"), ("t0", "int"), ("mae", "double"), ("rmse", "double"), ("mape", "double"))],
        "stage_order", "stage", "bin", "level",
    )
    if folds is None:
        return out
    rows = folds.select(F.lit("regression").alias("part"), F.col("fold").cast("int"), F.col("t0").cast("int"), "mae", "rmse", "mape")
    return out.unionByName(rows, allowMissingColumns=True)


def walk_forward_sizes(folds: DataFrame) -> DataFrame:
    return folds.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))
