"""Helpers every operator builds on: one-row summaries, global ranks, exact order statistics, top-k."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from risewatch.session import durable


BROADCAST_ROWS = 500_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table after counting it; beyond ``limit`` rows the join is left to Spark."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Rows of one task where the number of tasks follows the rows.
TASK_ROWS, FEW_TASKS = 500_000, 32


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many tasks as ``rows`` (those of the larger side of a join) ask for; rows of few tasks are left to Spark.

    Partitions that Spark merges by their compressed size may hold many millions of narrow rows, all sorted in one task.
    For keys of few rows each: a partition of a given number is not split when a key is hot.
    """
    return df.repartition(-(-rows // TASK_ROWS), *keys) if rows > FEW_TASKS * TASK_ROWS else df


def attach(df: DataFrame, summary: DataFrame, by: Sequence[str] = (), bounded: bool = True) -> DataFrame:
    """Add the columns of a summary holding one row per ``by`` group (one row in all when ``by`` is empty).

    ``bounded`` groups are folds and fixed feature lists, a handful of rows that may be broadcast. Without
    ``by`` the summary becomes a scalar subquery.
    """
    if by:
        return df.join(F.broadcast(summary) if bounded else summary, list(by))
    row = summary.select(F.struct(*summary.columns)).scalar()
    out = df.withColumn("_one", row)
    return out.select(*df.columns, *[F.col("_one")[c].alias(c) for c in summary.columns])


def occurrences(df: DataFrame) -> Column:
    """How many facts a group holds: rows, or the sum of ``n`` where equal facts were counted into one row."""
    return F.sum("n") if "n" in df.columns else F.count(F.lit(1))


def total(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def global_rank(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    name: str = "rn",
    slices: int | None = None,
) -> DataFrame:
    """``row_number`` over the whole table (or over large ``by`` groups) without a one-task sort.

    Rows are range-partitioned on ``(by, order)``; the slice id is frozen by a checkpoint, numbered inside
    each slice, and shifted by the sizes of the slices before it. ``order`` must end in a unique key.
    """
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = list(by)
    ranged = durable(
        df.repartitionByRange(n, *[F.col(c) for c in by], *order).withColumn("_slice", F.spark_partition_id())
    )
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*by, "_slice")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(*by, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    )
    local = F.row_number().over(W.partitionBy(*by, "_slice").orderBy(*order))
    return (
        ranged.withColumn("_local", local)
        .join(F.broadcast(offsets), [*by, "_slice"])  # at most `slices` + number of folds rows
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_slice", "_before", "_local")
    )


def order_stats(
    df: DataFrame,
    value: str,
    picks: Mapping[str, tuple[float, Callable[[Column], Column]]],
    by: Sequence[str] = (),
    bounded: bool = True,
) -> DataFrame:
    """Exact values at given sorted positions, one row per ``by``, plus ``n``, ``low`` and ``high``.

    ``picks`` maps an output name to ``(p, position)`` where ``position(n)`` is the zero-based index and
    ``p`` its approximate quantile. A sketch brackets every pick (its error is 1e-4 of the rows, the bracket
    is three times wider), only the bracket is then counted by value, so no task ever sees the whole column.
    """
    by = list(by)
    names = list(picks)
    slack = 3e-4
    probs = [
        q for k in names for q in (max(0.0, picks[k][0] - slack), min(1.0, picks[k][0] + slack))
    ]
    v = F.col(value).cast("double")
    src = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull())
    sketch = src.groupBy(*by).agg(
        F.count("_v").alias("n"),
        F.min("_v").alias("low"),
        F.max("_v").alias("high"),
        F.percentile_approx("_v", probs, 10000).alias("_q"),
    )
    small = F.col("n") <= 5000
    marked = attach(src, sketch, by, bounded).select(
        *by,
        "_v",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("pick"),
                        F.when(small, F.col("low")).otherwise(F.col("_q")[2 * i]).alias("lo"),
                        F.when(small, F.col("high")).otherwise(F.col("_q")[2 * i + 1]).alias("hi"),
                    )
                    for i in range(len(names))
                ]
            )
        ).alias("b"),
    )
    inside = (
        marked.where(F.col("_v") <= F.col("b.hi"))
        .select(*by, F.col("b.pick").alias("pick"), F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("_v"))
        .groupBy(*by, "pick", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    running = W.partitionBy(*by, "pick").orderBy(F.asc_nulls_first("_v"))
    cum = attach(inside.withColumn("_cum", F.sum("_c").over(running)), sketch.drop("_q"), by, bounded)
    hit = [
        F.min(
            F.when((F.col("pick") == i) & (F.col("_cum") > picks[k][1](F.col("n"))), F.col("_v"))
        ).alias(k)
        for i, k in enumerate(names)
    ]
    if by:
        return cum.groupBy(*by).agg(F.first("n").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"), *hit)
    return cum.agg(F.first("n").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"), *hit)


def quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (), bounded: bool = True
) -> DataFrame:
    """Exact linearly interpolated quantiles, one row per ``by``."""
    picks: dict[str, tuple[float, Callable[[Column], Column]]] = {}
    for name, p in probs.items():
        picks[f"{name}_lo"] = (p, lambda n, p=p: F.floor((n - 1) * F.lit(p)))
        picks[f"{name}_hi"] = (p, lambda n, p=p: F.ceil((n - 1) * F.lit(p)))
    stats = order_stats(df, value, picks, by, bounded)
    out = []
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return stats.select(*by, "n", "low", "high", *out)


def top_k(df: DataFrame, score: str, k: int, by: Sequence[str] = (), ident: str = "entity") -> DataFrame:
    """Highest scores first, ties by id, with the position in ``pos``."""
    order = [F.desc(score), F.asc(ident)]
    if by:
        # `row_number <= k` is cut on the map side too (WindowGroupLimit), so a group is never gathered whole.
        return df.withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("pos") <= k)
    return df.orderBy(*order).limit(k).withColumn("pos", F.row_number().over(W.orderBy(*order)))
