"""Copy-history link scores, filtered ranks and their metrics; keyed by ``by`` (for example ``fold``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from risewatch.operators.core import attach, occurrences
from risewatch.session import durable


def copy_history(train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count and share of each tail per (head, relation); sparse, one row per edge seen."""
    by = list(by)
    edges = train.groupBy(*by, "head", "relation", "tail").agg(occurrences(train).alias("freq"))
    sums = edges.groupBy(*by, "head", "relation").agg(F.sum("freq").alias("_all"))
    return edges.join(sums, [*by, "head", "relation"]).select(
        *by, "head", "relation", "tail", "freq", (F.col("freq") / F.col("_all")).alias("share")
    )


def copy_score(queries: DataFrame, history: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """History frequency of each queried edge, 0 when unseen."""
    keys = [*by, "head", "relation", "tail"]
    return queries.join(history.select(*keys, "freq"), keys, "left").withColumn(
        "score", F.coalesce("freq", F.lit(0)).cast("double")
    ).drop("freq")


def known_tails(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return facts.select(*by, "head", "relation", "tail").distinct()


def train_entities(train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return train.select(*by, F.explode(F.array("head", "tail")).alias("entity")).distinct()


def known_queries(
    test: DataFrame, train: DataFrame, by: Sequence[str] = (), entities: DataFrame | None = None
) -> DataFrame:
    """Test facts whose ends and relation occur in train (of the same fold)."""
    by = list(by)
    e = train_entities(train, by) if entities is None else entities
    return (
        test.join(e.withColumnRenamed("entity", "head"), [*by, "head"], "left_semi")
        .join(e.withColumnRenamed("entity", "tail"), [*by, "tail"], "left_semi")
        .join(train.select(*by, "relation").distinct(), [*by, "relation"], "left_semi")
    )


def filtered_rank(
    queries: DataFrame,
    scores: DataFrame,
    known: DataFrame,
    entities: DataFrame,
    by: Sequence[str] = (),
) -> DataFrame:
    """Average-tie rank of the true tail among all entities except the other known tails.

    ``scores`` holds the positive scores only (``head, relation, tail, score``); every other entity scores 0 and
    is counted, never listed. Queries meet the score levels of their (head, relation) through one ordered
    running count, so the work is linear in queries plus score rows even for a very popular head.
    """
    by = list(by)
    hr = [*by, "head", "relation"]
    edge = [*hr, "tail"]
    inside = durable(
        known.join(entities.withColumnRenamed("entity", "tail"), [*by, "tail"], "left_semi").select(*edge).distinct()
    )
    positive = scores.where(F.col("score") > 0).select(*edge, "score")
    free = durable(
        positive.join(inside, edge, "left_anti").join(
            entities.withColumnRenamed("entity", "tail"), [*by, "tail"], "left_semi"
        )
    )
    n_known = inside.groupBy(*hr).agg(F.count(F.lit(1)).alias("n_known"))
    n_free = free.groupBy(*hr).agg(F.count(F.lit(1)).alias("n_free"))
    universe = entities.groupBy(*by).agg(F.count(F.lit(1)).alias("n_entities")) if by else entities.agg(
        F.count(F.lit(1)).alias("n_entities")
    )
    distinct_q = queries.groupBy(*edge).agg(occurrences(queries).alias("times"))
    scored = durable(
        distinct_q.join(positive, edge, "left")
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
        .join(inside.withColumn("_in", F.lit(1)), edge, "left")
        .withColumn("is_known", F.coalesce("_in", F.lit(0)))
        .drop("_in")
        .join(n_known, hr, "left")
        .join(n_free, hr, "left")
        .fillna(0, subset=["n_known", "n_free"])
    )
    levels = free.groupBy(*hr, "score").agg(F.count(F.lit(1)).alias("_at"))
    asked = scored.where("score > 0").select(*hr, "score").distinct().withColumn("_at", F.lit(0).cast("bigint"))
    merged = levels.unionByName(asked).groupBy(*hr, "score").agg(F.sum("_at").alias("at"))
    above = W.partitionBy(*hr).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    ladder = merged.withColumn("above", F.coalesce(F.sum("at").over(above), F.lit(0)))
    placed = attach(scored.join(ladder, [*hr, "score"], "left"), universe, by)
    candidates = F.col("n_entities") - (F.col("n_known") - F.col("is_known"))
    hit = F.col("score") > 0
    higher = F.when(hit, F.coalesce("above", F.lit(0))).otherwise(F.col("n_free"))
    ties = F.when(hit, F.coalesce("at", F.lit(0)) + F.col("is_known")).otherwise(candidates - F.col("n_free"))
    return placed.select(
        *edge, "times", "score", (higher + 1 + (ties - 1) / 2).alias("rank")
    )


def rank_metrics(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean reciprocal rank and hits at 1, 3, 10 over ranked queries weighted by ``times``."""
    n = F.sum("times")
    cols = [
        (F.sum(F.col("times") / F.col("rank")) / n).alias("mrr"),
        *[(F.sum(F.when(F.col("rank") <= k, F.col("times")).otherwise(0)) / n).alias(f"hits_at_{k}") for k in (1, 3, 10)],
        n.alias("n_queries"),
    ]
    return ranks.groupBy(*by).agg(*cols) if by else ranks.agg(*cols)


def evaluate_copy_only(
    train: DataFrame, test: DataFrame, known: DataFrame | None = None, by: Sequence[str] = (), past: DataFrame | None = None
) -> DataFrame:
    """Filtered metrics of pure copying; ``past`` (default train) defines the entities that can be ranked."""
    past = train if past is None else past
    by = list(by)
    edge = [*by, "head", "relation", "tail"]
    facts = train.select(*edge).unionByName(test.select(*edge)) if known is None else known
    hist = durable(copy_history(train, by)).withColumn("score", F.col("share"))
    entities = durable(train_entities(past, by))
    queries = known_queries(test, past, by, entities)
    return rank_metrics(filtered_rank(queries, hist, known_tails(facts, by), entities, by), by)


def future_link_scores(history: DataFrame, test: DataFrame, train: DataFrame, relation: str | None = None) -> DataFrame:
    """Mean copy share of every candidate over the distinct test heads known to train (unseen pairs count 0)."""
    entities = train_entities(train)
    heads = test.select("head").distinct().join(entities.withColumnRenamed("entity", "head"), "head", "left_semi")
    rows = history if relation is None else history.where(F.col("relation") == relation)
    sums = rows.join(heads, "head", "left_semi").groupBy(F.col("tail").alias("entity")).agg(F.sum("share").alias("_s"))
    joined = entities.join(sums, "entity", "left")
    return attach(joined, heads.agg(F.count(F.lit(1)).alias("_h"))).where("_h > 0").select(
        "entity", (F.coalesce("_s", F.lit(0.0)) / F.col("_h")).alias("score")
    )
