"""Combining independent scores: rank scaling, outer joins, fusion and cross-examination."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risewatch.operators.core import attach, global_rank, top_k, total

# Default weights of the three signals.
FUSION_WEIGHTS = {"burst": 0.3, "tkg": 0.4, "forecast": 0.3}


def rank_normalize(scores: DataFrame, name: str = "scaled") -> DataFrame:
    """Best 1, worst 0, equal steps between (ties by id); a single entity gets 1."""
    ranked = global_rank(scores.select("entity", "score"), [F.desc("score"), F.asc("entity")])
    n = F.col("n")
    scaled = F.when(n == 1, 1.0).otherwise((n - F.col("rn")) / (n - 1))
    return attach(ranked, total(ranked)).select("entity", "score", scaled.alias(name))


def outer_scores(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Full outer join of score tables: one column per part (missing as 0) and a ``has_<part>`` flag."""
    out: DataFrame | None = None
    for name, df in parts.items():
        p = df.select("entity", F.col("score").alias(name))
        out = p if out is None else out.join(p, "entity", "full")
    flags = [F.col(n).isNotNull().alias(f"has_{n}") for n in parts]
    return out.select("entity", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in parts], *flags)


def fuse(
    burst: DataFrame, tkg: DataFrame, forecast: DataFrame, weights: Mapping[str, float] | None = None, k: int = 10
) -> DataFrame:
    """Weighted sum of three rank-scaled signals, best ``k``."""
    weights = weights or FUSION_WEIGHTS
    parts = {
        n: rank_normalize(d).select("entity", F.col("scaled").alias("score"))
        for n, d in (("burst", burst), ("tkg", tkg), ("forecast", forecast))
    }
    joined = outer_scores(parts)
    score = sum((F.col(n) * weights.get(n, 0.0) for n in parts), F.lit(0.0))
    return top_k(joined.withColumn("score", score), "score", k).select("entity", "score", *parts, "pos")


def forecast_signal(forecasts: DataFrame) -> DataFrame:
    """Expected relative growth ``(forecast - recent) / max(recent, 1e-6)``."""
    recent = F.col("recent_mean")
    return forecasts.select(
        F.col("entity"), ((F.col("forecast") - recent) / F.greatest(recent, F.lit(1e-6))).alias("score")
    )


def cross_examine(signal: DataFrame, link: DataFrame, weight: float = 0.5) -> DataFrame:
    """Verdict per entity from two rank-scaled scores (high means at least 0.5) and a consensus score."""
    s, l = rank_normalize(signal, "signal_rank"), rank_normalize(link, "link_rank")
    both = s.select("entity", F.col("score").alias("signal_score"), "signal_rank").join(
        l.select("entity", F.col("score").alias("link_score"), "link_rank"), "entity", "full"
    )
    has_s, has_l = F.col("signal_rank").isNotNull(), F.col("link_rank").isNotNull()
    sr, lr = F.coalesce("signal_rank", F.lit(0.0)), F.coalesce("link_rank", F.lit(0.0))
    verdict = (
        F.when((sr >= 0.5) & (lr >= 0.5), "agree")
        .when(sr >= 0.5, "signal_only")
        .when(lr >= 0.5, "tkg_only")
        .otherwise("neither")
    )
    ws = F.when(has_l, weight).otherwise(1.0)
    wl = F.when(has_s, 1.0 - weight).otherwise(1.0)
    consensus = F.when(ws + wl > 0, (ws * sr + wl * lr) / (ws + wl)).otherwise(0.0)
    return both.select(
        "entity",
        verdict.alias("verdict"),
        "signal_score",
        "link_score",
        sr.alias("signal_rank"),
        lr.alias("link_rank"),
        F.round(consensus, 6).alias("consensus"),
    )


def conflicts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("verdict").isin("signal_only", "tkg_only"))


def verdict_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
