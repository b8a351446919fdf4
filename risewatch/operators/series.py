"""Entity activity over observed time bins.

Most operators read their counts twice (once for the bin axis), so pass a stored table or a ``durable`` one:
the counts are far smaller than the mentions they come from.

A table of counts holds one row per ``(entity, bin)`` with ``cnt > 0``; absent cells are zeros. Every feature
below is computed from the sparse rows (zeros contribute through closed forms), so the entity x bin grid is
never built unless a caller asks for it with :func:`densify`. ``by`` is a list of extra grouping columns such
as ``fold``; ``holdout`` excludes the last bins of the axis while keeping their entities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from risewatch.functions.dates import time_bin
from risewatch.functions.numeric import log1p_safe, logistic
from risewatch.functions.text import tail_id
from risewatch.operators.core import attach, order_stats, small, top_k
from risewatch.session import durable

# Default feature weights of the share-momentum score.
SHARE_WEIGHTS = {
    "ema_short": 0.25,
    "macd": 0.30,
    "relative_growth": 0.20,
    "stability": 0.125,
    "persistence": 0.125,
}


def mention_rows(works: DataFrame) -> DataFrame:
    """Nested works to one row per concept mention: ``entity, time``."""
    return (
        works.where(F.col("publication_date").isNotNull() & (F.col("publication_date") != ""))
        .select(F.col("publication_date").alias("time"), F.explode("concepts").alias("c"))
        .select(tail_id(F.col("c.id")).alias("entity"), "time")
        .where(F.col("entity").isNotNull())
    )


def bin_counts(mentions: DataFrame, mode: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """Mentions per entity and bin; a concept repeated in one document counts each time."""
    # The explicit null test on the bin keeps this plan identical on both sides of a join with its own axis,
    # so the shuffle is computed once and reused.
    return (
        mentions.where(F.col("time") != "")
        .select(*by, "entity", time_bin(F.col("time"), mode).alias("bin"))
        .where(F.col("entity").isNotNull() & F.col("bin").isNotNull())
        .groupBy(*by, "entity", "bin")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def bin_totals(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*by, "bin").agg(F.sum("cnt").alias("total"))


def entity_totals(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*by, "entity").agg(F.sum("cnt").alias("total"))


def bin_axis(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Observed bins with their ordinal (from 1), the number of bins and the bin total.

    Bins are calendar months or days, so this table stays small whatever the data volume; it is stored, and
    joins check its size before they broadcast it.
    """
    return durable(
        bin_totals(counts, by)
        .withColumnRenamed("total", "bin_total")
        .withColumn("ord", F.row_number().over(W.partitionBy(*by).orderBy("bin")))
        .withColumn("n_bins", F.count(F.lit(1)).over(W.partitionBy(*by)))
    )


def indexed(counts: DataFrame, by: Sequence[str] = (), axis: DataFrame | None = None) -> DataFrame:
    """Counts with the axis columns."""
    axis = bin_axis(counts, by) if axis is None else axis
    return counts.join(small(axis), [*by, "bin"])


def densify(counts: DataFrame, by: Sequence[str] = (), axis: DataFrame | None = None) -> DataFrame:
    """The zero-filled grid over observed bins, expanded entity by entity from one grouped row."""
    axis = bin_axis(counts, by) if axis is None else axis
    labels = axis.groupBy(*by).agg(F.array_sort(F.collect_list("bin")).alias("_bins")) if by else axis.agg(
        F.array_sort(F.collect_list("bin")).alias("_bins")
    )
    rows = counts.groupBy(*by, "entity").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "cnt"))).alias("_cells")
    )
    return (
        attach(rows, labels, by)
        .select(*by, "entity", "_cells", F.explode("_bins").alias("bin"))
        .select(*by, "entity", "bin", F.coalesce(F.try_element_at("_cells", F.col("bin")), F.lit(0)).alias("cnt"))
    )


def series_arrays(
    counts: DataFrame, by: Sequence[str] = (), holdout: int = 0, axis: DataFrame | None = None
) -> DataFrame:
    """One row per entity with its zero-filled array ``x`` (length = number of kept bins)."""
    idx = indexed(counts, by, axis)
    cells = F.map_from_entries(F.collect_list(F.struct("ord", F.col("cnt").cast("double"))))
    return (
        idx.groupBy(*by, "entity")
        .agg(cells.alias("_cells"), (F.first("n_bins") - holdout).cast("int").alias("n"))
        .where(F.col("n") >= 1)
        .select(
            *by,
            "entity",
            "n",
            F.transform(
                F.sequence(F.lit(1), F.col("n")),
                lambda i: F.coalesce(F.try_element_at(F.col("_cells"), i), F.lit(0.0)),
            ).alias("x"),
        )
    )


def running_arrays(counts: DataFrame) -> DataFrame:
    """``series_arrays`` of the running totals, each array spread from its sparse cells without the dense grid."""
    own = W.partitionBy("entity").orderBy("ord")
    cells = indexed(counts).select("entity", "n_bins", F.struct("ord", F.sum("cnt").over(own).cast("double").alias("cum")).alias("_c"))
    rows = cells.groupBy("entity").agg(F.first("n_bins").cast("int").alias("n"), F.array_sort(F.collect_list("_c")).alias("_cells"))
    until = lambda i: F.coalesce(F.get("_cells", i + 1)["ord"], F.col("n") + 1)
    spans = F.transform("_cells", lambda c, i: F.array_repeat(c["cum"], (until(i) - c["ord"]).cast("int")))
    ahead = F.array_repeat(F.lit(0.0), (F.col("_cells")[0]["ord"] - 1).cast("int"))
    return rows.select("entity", "n", F.concat(ahead, F.flatten(spans)).alias("x"))


def _ema_weight(span: int, ordinal: Column, n: Column) -> Column:
    """Weight of the value at ``ordinal`` in an average seeded with the first value; 0 beyond ``n``."""
    alpha = 2.0 / (span + 1.0)
    decay = F.lit(1.0 - alpha)
    return (
        F.when(ordinal > n, 0.0).when(ordinal == 1, F.pow(decay, n - 1)).otherwise(alpha * F.pow(decay, n - ordinal))
    )


def ema(counts: DataFrame, span: int, by: Sequence[str] = (), holdout: int = 0) -> DataFrame:
    """Exponential moving average at the end of every entity's series."""
    n = F.col("n_bins") - holdout
    return (
        indexed(counts, by)
        .groupBy(*by, "entity")
        .agg(F.sum(F.col("cnt") * _ema_weight(span, F.col("ord"), n)).alias("ema"))
    )


def macd(counts: DataFrame, short: int = 3, long: int = 6, by: Sequence[str] = (), holdout: int = 0) -> DataFrame:
    """Short average minus long average, both in one pass."""
    n = F.col("n_bins") - holdout
    weight = _ema_weight(short, F.col("ord"), n) - _ema_weight(long, F.col("ord"), n)
    return indexed(counts, by).groupBy(*by, "entity").agg(F.sum(F.col("cnt") * weight).alias("macd"))


def share_series(counts: DataFrame, laplace: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Smoothed share of every entity in every observed bin (the dense result is the feature here)."""
    axis = bin_axis(counts, by)
    totals = axis.select(*by, "bin", F.col("bin_total").alias("total"))
    dense = densify(counts, by, axis).join(small(totals), [*by, "bin"])
    size = counts.groupBy(*by).agg(F.count_distinct("entity").alias("_n")) if by else counts.agg(
        F.count_distinct("entity").alias("_n")
    )
    return attach(dense, size, by).select(
        *by, "entity", "bin", ((F.col("cnt") + laplace) / (F.col("total") + laplace * F.col("_n"))).alias("share")
    )


def share_features(
    counts: DataFrame,
    by: Sequence[str] = (),
    holdout: int = 0,
    laplace: float = 1.0,
    short: int = 3,
    long: int = 6,
    min_bins: int = 3,
    axis: DataFrame | None = None,
) -> DataFrame:
    """The five share-momentum features per entity, from sparse counts in one grouped pass.

    With ``axis`` the caller fixes the bins and a column ``n`` of history bins; otherwise the last
    ``holdout`` bins are kept out of the history.
    """
    by = list(by)
    if axis is None:
        axis = bin_axis(counts, by).withColumn("n", F.col("n_bins") - holdout)
    universe = (
        counts.groupBy(*by).agg(F.count_distinct("entity").alias("_size"))
        if by
        else counts.agg(F.count_distinct("entity").alias("_size"))
    )
    o, n = F.col("ord"), F.col("n")
    axis = attach(axis, universe, by).withColumn("_den", F.col("bin_total") + laplace * F.col("_size"))
    ws, wl = _ema_weight(short, o, n), _ema_weight(long, o, n)
    constants = [
        F.sum(ws * laplace / F.col("_den")).alias("_base_s"),
        F.sum(wl * laplace / F.col("_den")).alias("_base_l"),
    ]
    base = axis.groupBy(*by).agg(*constants) if by else axis.agg(*constants)

    own = W.partitionBy(*by, "entity").orderBy("ord")
    level = F.log1p(F.col("cnt"))
    stepped = (
        counts.join(small(axis.drop("n_bins", "bin_total", "_size")), [*by, "bin"])
        .withColumn("_level", level)
        .withColumn("_prev", F.lag("ord").over(own))
        .withColumn("_prev_level", F.lag("_level").over(own))
        .withColumn("_next", F.lead("ord").over(own))
    )
    past = o <= n
    rise = F.when(F.col("_prev") == o - 1, F.col("_level") - F.col("_prev_level")).otherwise(F.col("_level"))
    up = F.when(past & (o > 1), rise * rise).otherwise(0.0)
    falls = past & (o < n) & (F.col("_next").isNull() | (F.col("_next") > o + 1))
    down = F.when(falls, F.col("_level") * F.col("_level")).otherwise(0.0)
    agg = stepped.groupBy(*by, "entity").agg(
        F.first("n").alias("n"),
        F.sum(F.col("cnt") * ws).alias("ema_short"),
        F.sum(F.col("cnt") * wl).alias("ema_long"),
        F.sum(F.col("cnt") * ws / F.col("_den")).alias("_share_s"),
        F.sum(F.col("cnt") * wl / F.col("_den")).alias("_share_l"),
        F.sum(up + down).alias("_g2"),
        F.sum(F.when(o == n, F.col("_level")).when(past & (o == 1), 0.0).otherwise(0.0)).alias("_last"),
        F.sum(F.when(past & (o == 1), F.col("_level")).otherwise(0.0)).alias("_first"),
        F.sum(F.when(past & (o > n - 12) & (F.col("cnt") > 0), 1).otherwise(0)).alias("_active"),
    )
    agg = attach(agg, base, by).where(F.col("n") >= min_bins)
    s, l = F.col("_share_s") + F.col("_base_s"), F.col("_share_l") + F.col("_base_l")
    steps = F.col("n") - 1
    drift = F.col("_last") - F.col("_first")
    variance = (F.col("_g2") - drift * drift / steps) / (steps - 1)
    volatility = F.when(steps > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(0.0)
    return agg.select(
        *by,
        "entity",
        F.col("ema_short"),
        (F.col("ema_short") - F.col("ema_long")).alias("macd"),
        F.when(l > 0, (s - l) / (l + 1e-6)).otherwise(0.0).alias("relative_growth"),
        (-volatility).alias("stability"),
        (F.col("_active") / F.least(F.lit(12), F.col("n"))).alias("persistence"),
    )


def robust_normalize(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median / IQR logistic scaling of each column to [0, 1]; min-max when the IQR is 0, 0.5 when flat."""
    by = list(by)
    stacked = df.select(
        *by, F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in cols])).alias("e")
    ).select(*by, F.col("e.f").alias("_f"), F.col("e.v").alias("_v"))
    stats = order_stats(
        stacked.withColumnRenamed("_v", "value"),
        "value",
        {
            "q1": (0.25, lambda n: F.floor(n / 4)),
            "med": (0.5, lambda n: F.floor(n / 2)),
            "q3": (0.75, lambda n: F.floor(n * 3 / 4)),
        },
        [*by, "_f"],
    )
    packed = [
        F.max(F.when(F.col("_f") == c, F.struct("n", "low", "high", "q1", "med", "q3"))).alias(f"_st_{c}")
        for c in cols
    ]
    one_row = stats.groupBy(*by).agg(*packed) if by else stats.agg(*packed)
    out = attach(df, one_row, by)
    for c in cols:
        st, v = F.col(f"_st_{c}"), F.col(c)
        spread = st["high"] - st["low"]
        flat = spread <= 1e-9 * F.greatest(F.abs(st["low"]), F.abs(st["high"]))
        iqr = st["q3"] - st["q1"]
        out = out.withColumn(
            f"{c}_norm",
            F.when(st["n"] < 2, 0.5)
            .when((iqr == 0) & flat, 0.5)
            .when(iqr == 0, (v - st["low"]) / spread)
            .otherwise(logistic((v - st["med"]) / (iqr / 1.34896))),
        )
    return out.drop(*[f"_st_{c}" for c in cols])


def share_momentum(
    counts: DataFrame,
    by: Sequence[str] = (),
    holdout: int = 0,
    weights: dict[str, float] | None = None,
    axis: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Score in [0, 1] per entity: who is gaining share of attention."""
    weights = weights or SHARE_WEIGHTS
    scale = sum(weights.values())
    if scale <= 0:
        raise ValueError("feature weights must sum to a positive number")
    # One row per entity, read several times by the normalisation below: computed once.
    feats = durable(share_features(counts, by, holdout, axis=axis, **options))
    normed = robust_normalize(feats, list(weights), by)
    score = sum(F.col(f"{k}_norm") * w for k, w in weights.items()) / scale
    return normed.select(*by, "entity", score.alias("score"))


def share_momentum_topk(counts: DataFrame, k: int = 10, by: Sequence[str] = (), **options) -> DataFrame:
    return top_k(share_momentum(counts, by, **options), "score", k, by)


def future_growth(counts: DataFrame, m: int, by: Sequence[str] = (), axis: DataFrame | None = None) -> DataFrame:
    """Mean of the last ``m`` bins minus the mean of the bins before; no rows when there is no history."""
    n, o = F.col("n_bins"), F.col("ord")
    return (
        indexed(counts, by, axis)
        .where(n > m)
        .groupBy(*by, "entity")
        .agg(
            (
                F.sum(F.when(o > n - m, F.col("cnt")).otherwise(0)) / m
                - F.sum(F.when(o <= n - m, F.col("cnt")).otherwise(0)) / (F.first("n_bins") - m)
            ).alias("growth")
        )
    )


def future_activity(counts: DataFrame, m: int, by: Sequence[str] = (), axis: DataFrame | None = None) -> DataFrame:
    """Mean of the last ``m`` bins."""
    n, o = F.col("n_bins"), F.col("ord")
    return (
        indexed(counts, by, axis)
        .where(n > m)
        .groupBy(*by, "entity")
        .agg((F.sum(F.when(o > n - m, F.col("cnt")).otherwise(0)) / m).alias("activity"))
    )


def growth_topk(counts: DataFrame, m: int = 6, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    return top_k(future_growth(counts, m, by), "growth", k, by)


def persistence(counts: DataFrame, span: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Share of the last ``span`` bins in which the entity is active."""
    n, o = F.col("n_bins"), F.col("ord")
    return (
        indexed(counts, by)
        .groupBy(*by, "entity")
        .agg(
            (F.sum(F.when((o > n - span) & (F.col("cnt") > 0), 1).otherwise(0)) / F.first(F.least(F.lit(span), n))).alias(
                "persistence"
            )
        )
    )


def log_growth(dense: DataFrame, value: str = "cnt") -> DataFrame:
    """Log growth between consecutive bins of a dense series."""
    level = log1p_safe(F.col(value).cast("double"))
    return dense.withColumn("growth", level - F.lag(level).over(W.partitionBy("entity").orderBy("bin")))


def cumulate(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running total over the dense grid, monotone by construction."""
    own = W.partitionBy(*by, "entity").orderBy("bin")
    return densify(counts, by).withColumn("cum", F.sum("cnt").over(own))


def top_active(counts: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    return top_k(entity_totals(counts, by), "total", k, by)


def trend_series(counts: DataFrame, k: int = 6) -> DataFrame:
    """Dense series of the most active entities: filter first, densify the few that remain."""
    keep = F.broadcast(top_active(counts, k).select("entity"))  # k rows
    axis = bin_axis(counts).agg(F.array_sort(F.collect_list("bin")).alias("_bins"))
    rows = (
        counts.join(keep, "entity", "left_semi")
        .groupBy("entity")
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "cnt"))).alias("_cells"))
    )
    return attach(rows, axis).select("entity", "_cells", F.explode("_bins").alias("bin")).select(
        "entity", "bin", F.coalesce(F.try_element_at("_cells", F.col("bin")), F.lit(0)).alias("cnt")
    )
