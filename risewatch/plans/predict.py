"""Single-split evaluations: burst, share and fusion rankings against later growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risewatch.operators import metrics
from risewatch.operators.bursts import burst_scores, burst_topk
from risewatch.operators.fusion import FUSION_WEIGHTS, fuse
from risewatch.operators.series import growth_topk, share_momentum, share_momentum_topk


def baselines(
    counts: DataFrame,
    future: int = 6,
    k: int = 10,
    rankings: Sequence[str] = ("share", "burst"),
    tkg: DataFrame | None = None,
    forecast: DataFrame | None = None,
    signal: str = "share",
) -> DataFrame:
    """Precision and recall at ``k`` per ranking; ``fusion`` needs the link and forecast scores."""
    truth = growth_topk(counts, future, k)
    out: DataFrame | None = None
    for name in rankings:
        if name == "share":
            ranked = share_momentum_topk(counts, k, holdout=future)
        elif name == "burst":
            ranked = burst_topk(counts, k, holdout=future)
        elif name == "fusion":
            first = (
                share_momentum(counts, holdout=future)
                if signal == "share"
                else burst_scores(counts, holdout=future).select("entity", F.col("weight").alias("score"))
            )
            ranked = fuse(first, tkg, forecast, FUSION_WEIGHTS, k)
        else:
            raise ValueError(f"unknown ranking: {name!r}")
        row = metrics.precision_recall(ranked, truth, k).withColumn("ranking", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
