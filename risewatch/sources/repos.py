"""Repository search items, snapshot signals and star logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from risewatch.operators.extract import dedupe_by_id


def normalize_repos(raw: DataFrame) -> DataFrame:
    """Search items to repositories; an item met under several topics is kept once (first fetched)."""
    rows = raw.select(
        F.concat(F.lit("github:"), F.coalesce("full_name", F.lit(""))).alias("id"),
        F.lit("github").alias("source"),
        F.coalesce("full_name", F.lit("")).alias("name"),
        "description",
        F.col("html_url").alias("url"),
        F.coalesce("stargazers_count", F.lit(0)).alias("stars"),
        F.coalesce("topics", F.array().cast("array<string>")).alias("topics"),
        F.substring(F.coalesce("created_at", F.lit("")), 1, 10).alias("created_at"),
        "fetched_seq",
    )
    return dedupe_by_id(rows, F.col("fetched_seq")).drop("fetched_seq")


def repo_signals(
    raw: DataFrame, as_of: str, languages: Sequence[str] = (), owners: Sequence[str] = (), recent_days: int = 3
) -> DataFrame:
    """Snapshot features per (topic, repository), the copy with most stars kept."""
    rows = raw
    if languages:
        rows = rows.where(F.col("language").isin(*languages))
    if owners:
        rows = rows.where(F.col("owner.login").isin(*owners))
    stars = F.coalesce("stargazers_count", F.lit(0))
    best = rows.groupBy("topic_id", F.col("id").alias("repo_id")).agg(
        F.max_by(
            F.struct(
                "full_name", stars.alias("stars_total"), F.coalesce("forks_count", F.lit(0)).alias("forks_total"),
                "language", "created_at", "pushed_at", "topic_label", "_window",
            ),
            F.struct(stars.alias("s"), (-F.coalesce("fetched_seq", F.lit(0))).alias("q")),
        ).alias("b")
    ).select("topic_id", "repo_id", "b.*")
    now = F.to_timestamp(F.lit(as_of))
    days = lambda c: F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp(c))) / 86400)
    age = F.coalesce(F.greatest(F.lit(1), days(F.col("created_at"))), F.lit(1))
    return best.select(
        "repo_id",
        "full_name",
        "stars_total",
        F.round(F.col("stars_total") / age, 3).alias("stars_per_day_lifetime"),
        "forks_total",
        F.when(days(F.col("pushed_at")) <= recent_days, 1).otherwise(0).alias("activity_recent"),
        "language",
        "created_at",
        "topic_id",
        "topic_label",
        "_window",
    )


def repo_topic_rollup(signals: DataFrame) -> DataFrame:
    """Repositories, stars, forks and recently active repositories per topic."""
    return signals.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("repos_count"),
        F.sum("stars_total").alias("stars_total"),
        F.sum("forks_total").alias("forks_total"),
        F.sum("activity_recent").alias("activity_recent_count"),
    )


def snapshot_delta(stars: DataFrame) -> DataFrame:
    """Change of stars between consecutive snapshots of a repository."""
    own = W.partitionBy("full_name").orderBy("fetched_at")
    return stars.withColumn("delta", F.col("stars") - F.lag("stars").over(own))
