"""Two-state burst segmentation of count series (Kleinberg 2002), run inside the row of each entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risewatch.operators.core import top_k
from risewatch.operators.series import series_arrays


_NONE = "cast(array() as array<int>)"


def burst_sql(x: str, n: str, s: str, gamma: str) -> str:
    """SQL text of the burst segments of ``x`` (array of counts) over ``n`` bins: array of (start, end, weight).

    The cheapest path into each state is kept as the list of bins where it changes state, so a step that stays in its
    state copies nothing; ties go to state 0. Without any count there is no segment.
    """
    x, n, s, gamma = f"({x})", f"cast({n} as int)", f"cast({s} as double)", f"cast({gamma} as double)"
    cost = lambda rate: f"CASE WHEN {rate} > 0 THEN {rate} - v * ln({rate}) WHEN v = 0 THEN 0D ELSE double('Infinity') END"
    stay, enter = "a.t = 0 OR a.c0 <= a.c1 + a.tau", "a.t = 0 OR a.c0 + a.tau <= a.c1"
    changes = f"""aggregate({x},
      named_struct('t', 0, 'c0', 0D, 'c1', 0D, 'p0', {_NONE}, 'p1', {_NONE},
        'rate', IF({n} > 0, aggregate({x}, 0D, (a, v) -> a + v) / greatest({n}, 1), 0D), 'tau', IF({n} > 1, {gamma} * ln(greatest({n}, 1)), 0D)),
      (a, v) -> named_struct('t', a.t + 1,
        'c0', {cost("a.rate")} + CASE WHEN a.t = 0 THEN 0D WHEN {stay} THEN a.c0 ELSE a.c1 + a.tau END,
        'c1', {cost(f"(a.rate * {s})")} + CASE WHEN a.t = 0 THEN 0D WHEN {enter} THEN a.c0 + a.tau ELSE a.c1 END,
        'p0', IF({stay}, a.p0, concat(a.p1, array(a.t))), 'p1', IF({enter}, concat(a.p0, array(a.t)), a.p1), 'rate', a.rate, 'tau', a.tau),
      a -> CASE WHEN a.rate <= 0 THEN {_NONE} WHEN a.c0 <= a.c1 THEN a.p0 ELSE a.p1 END)"""
    # a burst begins at every other change and ends before the next, or with the series
    start, length = "get(w, i - 1)", f"(coalesce(get(w, i), {n}) - get(w, i - 1))"
    return f"""transform(array({changes}), w -> IF(size(w) = 0, cast(array() as array<struct<start: int, `end`: int, weight: double>>),
      transform(sequence(1, greatest(size(w), 1), 2), i -> named_struct('start', {start}, 'end', {start} + {length} - 1, 'weight', array_max(slice({x}, {start} + 1, {length}))))))[0]"""


def burst_arrays(
    counts: DataFrame,
    s: float = 2.0,
    gamma: float = 1.0,
    by: Sequence[str] = (),
    holdout: int = 0,
    axis: DataFrame | None = None,
) -> DataFrame:
    """Per entity the array ``bursts`` of ``(start, end, weight)``; bins count from 0, ends included."""
    rows = series_arrays(counts, by, holdout, axis)
    return rows.select(*by, "entity", F.expr(burst_sql("x", "n", repr(float(s)), repr(float(gamma)))).alias("bursts"))


def kleinberg_bursts(counts: DataFrame, s: float = 2.0, gamma: float = 1.0, **options) -> DataFrame:
    """Burst segments as rows: ``entity, start, end, weight``."""
    by = list(options.get("by", ()))
    return burst_arrays(counts, s, gamma, **options).select(*by, "entity", F.explode("bursts").alias("b")).select(
        *by, "entity", "b.start", "b.end", "b.weight"
    )


def burst_scores(counts: DataFrame, s: float = 2.0, gamma: float = 1.0, **options) -> DataFrame:
    """Largest burst weight (0 without a burst) and number of bursts per entity."""
    by = list(options.get("by", ()))
    return burst_arrays(counts, s, gamma, **options).select(
        *by,
        "entity",
        F.coalesce(F.array_max(F.transform("bursts", lambda b: b["weight"])), F.lit(0.0)).alias("weight"),
        F.size("bursts").alias("n_bursts"),
    )


def burst_topk(counts: DataFrame, k: int = 10, s: float = 2.0, gamma: float = 1.0, **options) -> DataFrame:
    return top_k(burst_scores(counts, s, gamma, **options), "weight", k, list(options.get("by", ())))
