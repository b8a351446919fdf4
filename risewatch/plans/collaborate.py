"""Two independent views of every concept, momentum and link history, examined against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risewatch.operators import generate, links
from risewatch.operators.extract import with_names
from risewatch.operators.factors import fit_factors
from risewatch.operators.fusion import cross_examine
from risewatch.operators.graph import temporal_split
from risewatch.operators.series import share_momentum
from risewatch.session import durable


def link_scores(facts: DataFrame, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """Future link scores from the copy history of the training span.

    Candidates and queried heads are the entities of the past (training plus validation span).
    """
    split = durable(temporal_split(facts, train, val))
    role = lambda *r: split.where(F.col("role").isin(*r)).drop("role")
    history = links.copy_history(role("train"))
    return links.future_link_scores(history, role("test"), role("train", "val"))


def blended_link_scores(facts: DataFrame, train: float = 0.7, val: float = 0.1, alpha: float = 0.5, dim: int = 16, max_iter: int = 5) -> DataFrame:
    """Future link scores of the blended model: copy shares and factors of the training span.

    Candidates and queried heads are those of ``link_scores``; an entity known from the validation span alone has zero factors.
    """
    split = durable(temporal_split(facts, train, val))
    role = lambda *r: split.where(F.col("role").isin(*r)).drop("role")
    factors = tuple(durable(f) for f in fit_factors(role("train"), (), dim, max_iter=max_iter, entities=links.train_entities(role("train", "val"))))
    return generate.future_link_scores(links.copy_history(role("train")), role("test"), factors, alpha=alpha)


def collaborate(
    counts: DataFrame,
    facts: DataFrame,
    named: DataFrame | None = None,
    future: int = 6,
    weight: float = 0.5,
) -> DataFrame:
    """Consensus rows with verdicts; ``named`` (``entity, name, seq``) adds display names."""
    rows = cross_examine(share_momentum(counts, holdout=future), link_scores(facts), weight)
    return rows if named is None else with_names(rows, named, F.col("seq"))
