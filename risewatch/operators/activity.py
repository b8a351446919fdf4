"""Activity records per (source, topic, window): clean, pivot, tag, fill, standardise, smooth, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from risewatch.functions.numeric import log1p_safe
from risewatch.operators.core import attach, quantiles

# The six sources and the tag names.
SOURCES = ("openalex", "crossref", "arxiv", "uspto", "gdelt", "github")
API_FAILURE = "likely_api_failure"
SUDDEN_DROP = "sudden_drop"


def is_ok(ok_statuses: Sequence[str] = ("ok",)) -> Column:
    status = F.coalesce(F.col("collection_status"), F.lit("ok"))
    return status.isin(*ok_statuses) & F.col("activity_count").isNotNull()


def split_failed(records: DataFrame, ok_statuses: Sequence[str] = ("ok",)) -> tuple[DataFrame, DataFrame]:
    """Usable and failed records; a missing status counts as ok, a missing count as failed."""
    ok = is_ok(ok_statuses)
    return records.where(ok), records.where(~ok)


def cleaning_log(records: DataFrame) -> DataFrame:
    """Input, ok and failed counts per source and in total (null source) in one pass."""
    ok = is_ok()
    return records.rollup("source").agg(
        F.count(F.lit(1)).alias("input_count"),
        F.count_if(ok).alias("ok_count"),
        F.count_if(~ok).alias("failed_count"),
    )


def _request_ok() -> Column:
    return F.coalesce(F.col("collection_status"), F.lit("")) == "ok"


def collection_report(records: DataFrame) -> DataFrame:
    """Ok and failed requests per topic and source."""
    return records.groupBy("topic_id", "source").agg(
        F.max("topic_label").alias("topic_label"),
        F.count_if(_request_ok()).alias("ok"),
        F.count_if(~_request_ok()).alias("failed"),
    )


def collection_errors(records: DataFrame) -> DataFrame:
    """Error texts per topic and source with their number of occurrences.

    A source may fail in very many ways, so the list stays in rows and is never gathered into one cell.
    """
    failed = records.where(~_request_ok())
    return failed.groupBy("topic_id", "source", F.coalesce("error", F.lit("unknown")).alias("error")).agg(
        F.count(F.lit(1)).alias("times")
    )


def merge_sources(*frames: DataFrame) -> DataFrame:
    """Union by name; columns missing in a source become null. Sort at the sink, not here."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def feature_matrix(records: DataFrame) -> DataFrame:
    """Records laid out topic by topic in window and source order.

    A topic may hold most of the records, so the order is a range layout over all three keys: a large topic
    spans several partitions instead of being gathered into one array.
    """
    keys = ["topic_id", "window_start", "source"]
    return records.repartitionByRange(*keys).sortWithinPartitions(*keys)


def activity_pivot(records: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """One row per topic and window, one ``<source>_count`` column per known source (sum, junk as 0)."""
    count = F.coalesce(F.col("activity_count").try_cast("double"), F.lit(0.0))
    keys = ["topic_id", "topic_label", "window_start", "window_end"]
    wide = records.groupBy(*keys).pivot("source", list(sources)).agg(F.sum(count))
    return wide.select(*keys, *[F.coalesce(F.col(s), F.lit(0.0)).alias(f"{s}_count") for s in sources])


def count_columns(pivot: DataFrame) -> list[str]:
    return [c for c in pivot.columns if c.endswith("_count")]


def melt(pivot: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long form ``topic_id, window_start, source, value`` of the count columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).cast("double").alias("value")) for c in cols])
    return pivot.select("topic_id", "window_start", F.explode(pairs).alias("e")).select(
        "topic_id", "window_start", "e.source", "e.value"
    )


_SERIES = ("topic_id", "source")


def zscore_outlier(long: DataFrame, threshold: float = 3.0, window: int = 6) -> DataFrame:
    """Distance of log1p(value) from the preceding ``window`` rows, population deviation."""
    before = W.partitionBy(*_SERIES).orderBy("window_start").rowsBetween(-window, -1)
    level = log1p_safe(F.col("value"))
    mean, sd, n = F.avg(level).over(before), F.stddev_pop(level).over(before), F.count(level).over(before)
    flag = (n >= 2) & (sd >= 1e-9) & (F.abs((level - mean) / sd) > threshold)
    return long.withColumn("zscore_outlier", F.coalesce(flag, F.lit(False)))


def iqr_outlier(long: DataFrame, k: float = 1.5, window: int = 6) -> DataFrame:
    """Outside the fences of index quartiles over the preceding ``window`` rows."""
    before = W.partitionBy(*_SERIES).orderBy("window_start").rowsBetween(-window, -1)
    past = F.sort_array(F.collect_list("value").over(before))
    out = long.withColumn("_past", past).withColumn("_m", F.size("_past"))
    q1 = F.get(F.col("_past"), F.floor(F.col("_m") / 4).cast("int"))
    q3 = F.get(F.col("_past"), F.floor(F.col("_m") * 3 / 4).cast("int"))
    iqr = q3 - q1
    flag = (
        (F.col("_m") >= 4)
        & (iqr >= 1e-9)
        & ((F.col("value") < q1 - k * iqr) | (F.col("value") > q3 + k * iqr))
    )
    return out.withColumn("iqr_outlier", F.coalesce(flag, F.lit(False))).drop("_past", "_m")


def zero_runs(long: DataFrame, min_run: int = 3) -> DataFrame:
    """Tag every zero of a run of at least ``min_run`` zeros."""
    order = W.partitionBy(*_SERIES).orderBy("window_start")
    marked = long.withColumn("_island", F.sum(F.when(F.col("value") != 0, 1).otherwise(0)).over(order))
    run = F.sum(F.when(F.col("value") == 0, 1).otherwise(0)).over(W.partitionBy(*_SERIES, "_island"))
    tag = F.when((F.col("value") == 0) & (run >= min_run), API_FAILURE).otherwise("")
    return marked.withColumn("zero_run_tag", tag).drop("_island")


def sudden_drop(long: DataFrame, min_before: int = 3) -> DataFrame:
    """Tag a non-positive value directly after at least ``min_before`` positive ones."""
    order = W.partitionBy(*_SERIES).orderBy("window_start")
    stop = F.when(F.col("value") <= 0, 1).otherwise(0)
    marked = long.withColumn("_island", F.coalesce(F.sum(stop).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    positives = F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).over(
        W.partitionBy(*_SERIES, "_island").orderBy("window_start").rowsBetween(W.unboundedPreceding, -1)
    )
    tag = F.when((F.col("value") <= 0) & (positives >= min_before), SUDDEN_DROP).otherwise("")
    return marked.withColumn("drop_tag", tag).drop("_island")


def tag_long(
    long: DataFrame, threshold: float = 3.0, k: float = 1.5, min_zeros: int = 3, min_before: int = 3
) -> DataFrame:
    """All four tags per cell; a zero-run tag wins over a drop tag."""
    out = sudden_drop(zero_runs(iqr_outlier(zscore_outlier(long, threshold), k), min_zeros), min_before)
    tag = F.when(F.col("zero_run_tag") != "", F.col("zero_run_tag")).otherwise(F.col("drop_tag"))
    return (
        out.withColumn("zero_tag", tag)
        .withColumn("any_anomaly", F.col("zscore_outlier") | F.col("iqr_outlier") | (F.col("zero_tag") != ""))
        .drop("zero_run_tag", "drop_tag")
    )


_TAGS = ("zscore_outlier", "iqr_outlier", "zero_tag", "any_anomaly")


def tag_anomalies(pivot: DataFrame, cols: Sequence[str] | None = None, **limits) -> DataFrame:
    """Pivot rows with ``<col>_zscore_outlier``, ``_iqr_outlier``, ``_zero_tag`` and ``_any_anomaly``."""
    cols = list(cols or count_columns(pivot))
    tagged = tag_long(melt(pivot, cols), **limits)
    wide = tagged.groupBy("topic_id", "window_start").agg(
        *[F.max(F.when(F.col("source") == c, F.col(t))).alias(f"{c}_{t}") for c in cols for t in _TAGS]
    )
    return pivot.join(wide, ["topic_id", "window_start"], "left")


def anomaly_summary(tagged: DataFrame) -> DataFrame:
    """Anomalies and cells per source, per topic and in total (grouping sets in one pass)."""
    flags = [c for c in tagged.columns if c.endswith("_any_anomaly")]
    pairs = F.array(
        *[F.struct(F.lit(c.removesuffix("_any_anomaly")).alias("source"), F.col(c).alias("hit")) for c in flags]
    )
    cells = tagged.select("topic_id", F.explode(pairs).alias("e")).select("topic_id", "e.source", "e.hit")
    return cells.groupingSets([["source"], ["topic_id"], []], "source", "topic_id").agg(
        F.count_if("hit").alias("anomalies"), F.count(F.lit(1)).alias("total")
    ).select(
        F.when(F.col("source").isNotNull(), "source").when(F.col("topic_id").isNotNull(), "topic").otherwise("all").alias("level"),
        F.coalesce("source", "topic_id", F.lit("")).alias("name"),
        "anomalies",
        "total",
    )


def _drop_rules(
    tagged: DataFrame, cols: Sequence[str], flags: dict[str, bool]
) -> tuple[DataFrame, dict[str, Column]]:
    """Tagged rows with the activity flags of each column and one Boolean expression per rule."""
    sums = tagged.agg(*[(F.sum(c) > 0).alias(f"_act_{c}") for c in cols])
    rows = attach(tagged, sums)
    some = F.lit(False)
    for c in cols:
        some = some | F.col(f"_act_{c}")

    def any_of(suffix: str) -> Column:
        out = F.lit(False)
        for c in cols:
            out = out | (F.col(f"_act_{c}") & F.coalesce(F.col(f"{c}_{suffix}"), F.lit(False)))
        return out

    def all_tagged(tag: str) -> Column:
        out = some
        for c in cols:
            out = out & (~F.col(f"_act_{c}") | (F.coalesce(F.col(f"{c}_zero_tag"), F.lit("")) == tag))
        return out

    rules = {
        "zscore": any_of("zscore_outlier"),
        "iqr": any_of("iqr_outlier"),
        API_FAILURE: all_tagged(API_FAILURE),
        SUDDEN_DROP: all_tagged(SUDDEN_DROP),
    }
    return rows, {k: v if flags[k] else F.lit(False) for k, v in rules.items()}


def drop_anomalous(
    tagged: DataFrame,
    cols: Sequence[str] | None = None,
    drop_zscore: bool = False,
    drop_iqr: bool = False,
    drop_api_failure: bool = True,
    drop_sudden_drop: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Rows kept, and one row of drop counts per rule. Only sources with any activity take part."""
    cols = list(cols or [c for c in count_columns(tagged)])
    flags = {"zscore": drop_zscore, "iqr": drop_iqr, API_FAILURE: drop_api_failure, SUDDEN_DROP: drop_sudden_drop}
    rows, rules = _drop_rules(tagged, cols, flags)
    dropped = F.lit(False)
    for r in rules.values():
        dropped = dropped | r
    counts = rows.agg(
        *[F.count_if(r).alias(k) for k, r in rules.items()], F.count_if(dropped).alias("total_dropped")
    )
    return rows.where(~dropped).select(*tagged.columns), counts


def fill_windows(
    pivot: DataFrame, windows: DataFrame, strategy: str = "zero_fill", cols: Sequence[str] | None = None
) -> DataFrame:
    """Every topic x window; gaps become 0 or the last value, other columns the last value.

    ``windows`` is the bounded window catalogue (``window_start``); it is expanded inside each topic row.
    """
    if strategy not in ("zero_fill", "forward_fill"):
        raise ValueError(f"unknown fill strategy: {strategy!r}")
    cols = list(cols or count_columns(pivot))
    catalogue = windows.agg(F.array_sort(F.collect_set("window_start")).alias("_windows"))
    topics = pivot.groupBy("topic_id").agg(F.min_by("topic_label", "window_start").alias("topic_label"))
    grid = attach(topics, catalogue).select("topic_id", "topic_label", F.explode("_windows").alias("window_start"))
    joined = grid.join(pivot.drop("topic_label"), ["topic_id", "window_start"], "left")
    seen = W.partitionBy("topic_id").orderBy("window_start").rowsBetween(W.unboundedPreceding, 0)
    out = []
    for c in joined.columns:
        if c in cols:
            filled = F.last(c, ignorenulls=True).over(seen) if strategy == "forward_fill" else F.col(c)
            out.append(F.coalesce(filled, F.lit(0.0)).alias(c))
        elif c in ("topic_id", "topic_label", "window_start"):
            out.append(F.col(c))
        else:
            out.append(F.last(c, ignorenulls=True).over(seen).alias(c))
    return joined.select(*out, F.col(cols[0]).isNull().alias("_filled"))


def standardize(pivot: DataFrame, method: str = "robust", cols: Sequence[str] | None = None) -> DataFrame:
    """``<col>_std`` compared across topics inside each window."""
    cols = list(cols or count_columns(pivot))
    if method not in ("robust", "rank", "log1p", "minmax"):
        raise ValueError(f"unknown standardization method: {method!r}")
    long = melt(pivot, cols)
    if method == "log1p":
        long = long.withColumn("value", F.log1p(F.greatest(F.col("value"), F.lit(0.0))))
    keys = ["window_start", "source"]
    if method == "robust":
        stats = quantiles(long, "value", {"q1": 0.25, "med": 0.5, "q3": 0.75}, keys, bounded=False)
        iqr = F.col("q3") - F.col("q1")
        std = F.when(iqr < 1e-9, 0.0).otherwise(F.round((F.col("value") - F.col("med")) / iqr, 4))
    elif method == "rank":
        ties = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("ties"))
        below = W.partitionBy(*keys).orderBy("value").rowsBetween(W.unboundedPreceding, -1)
        ranked = ties.withColumn("below", F.coalesce(F.sum("ties").over(below), F.lit(0)))
        sizes = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        values = ranked.join(sizes, keys).select(
            *keys,
            "value",
            F.when(F.col("n") <= 1, 0.5)
            .otherwise(F.round((F.col("below") + (F.col("ties") - 1) / 2) / (F.col("n") - 1), 4))
            .alias("std"),
        )
        return _pivot_std(pivot, long.join(values, [*keys, "value"]), cols)
    else:
        stats = long.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        spread = F.col("hi") - F.col("lo")
        std = F.when(spread < 1e-9, 0.5).otherwise(F.round((F.col("value") - F.col("lo")) / spread, 4))
    return _pivot_std(pivot, long.join(stats, keys).withColumn("std", std), cols)


def _pivot_std(pivot: DataFrame, long: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = long.groupBy("topic_id", "window_start").agg(
        *[F.max(F.when(F.col("source") == c, F.col("std"))).alias(f"{c}_std") for c in cols]
    )
    return pivot.join(wide, ["topic_id", "window_start"])


def smooth(pivot: DataFrame, size: int = 3, method: str = "median", cols: Sequence[str] | None = None) -> DataFrame:
    """Trailing median or mean of ``size`` rows, shorter at the start, rounded to 2."""
    cols = list(cols or count_columns(pivot))
    trail = W.partitionBy("topic_id").orderBy("window_start").rowsBetween(-(size - 1), 0)
    if method == "median":
        def level(c: str) -> Column:
            kept = F.sort_array(F.collect_list(c).over(trail))
            n = F.size(kept)
            return (F.get(kept, F.floor((n - 1) / 2).cast("int")) + F.get(kept, F.floor(n / 2).cast("int"))) / 2
    else:
        def level(c: str) -> Column:
            return F.avg(c).over(trail)
    return pivot.select("*", *[F.round(level(c), 2).alias(f"{c}_smoothed") for c in cols])


def extend_pivot(pivot: DataFrame, signals: DataFrame) -> DataFrame:
    """Repository totals by topic and month of creation next to the pivot row; absent as 0."""
    monthly = (
        signals.groupBy("topic_id", F.substring(F.coalesce("created_at", F.lit("unknown")), 1, 7).alias("window_start"))
        .agg(
            F.sum("stars_total").alias("github_stars_total"),
            F.sum("stars_per_day_lifetime").alias("github_stars_per_day"),
            F.sum("forks_total").alias("github_forks_total"),
            F.sum("activity_recent").alias("github_activity_recent"),
        )
    )
    names = ["github_stars_total", "github_stars_per_day", "github_forks_total", "github_activity_recent"]
    return pivot.join(monthly, ["topic_id", "window_start"], "left").fillna(0, subset=names)


def topic_coverage(pivot: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per topic: windows, filled windows, coverage per source and overall."""
    cols = list(cols or count_columns(pivot))
    filled = F.count_if("_filled") if "_filled" in pivot.columns else F.lit(0).cast("bigint")
    per = pivot.groupBy("topic_id").agg(
        F.min_by("topic_label", "window_start").alias("label"),
        F.count(F.lit(1)).alias("windows"),
        filled.alias("filled_windows"),
        *[(F.count_if(F.col(c) > 0) / F.count(F.lit(1))).alias(f"{c.removesuffix('_count')}_coverage") for c in cols],
        F.sum(sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in cols), F.lit(0))).alias("_hits"),
    )
    return per.withColumn("overall_coverage", F.col("_hits") / (F.col("windows") * len(cols))).drop("_hits")


def source_coverage(pivot: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per source: coverage, anomaly count and number of windows."""
    cols = list(cols or count_columns(pivot))
    tagged = [f"{c}_any_anomaly" in pivot.columns for c in cols]
    cells = F.array(
        *[
            F.struct(
                F.lit(c.removesuffix("_count")).alias("source"),
                (F.col(c) > 0).alias("hit"),
                (F.coalesce(F.col(f"{c}_any_anomaly"), F.lit(False)) if t else F.lit(False)).alias("bad"),
            )
            for c, t in zip(cols, tagged)
        ]
    )
    return (
        pivot.select(F.explode(cells).alias("e"))
        .groupBy("e.source")
        .agg(
            (F.count_if("e.hit") / F.count(F.lit(1))).alias("coverage"),
            F.count_if("e.bad").alias("anomaly_count"),
            F.count(F.lit(1)).alias("total_windows"),
        )
    )


def quality_issues(pivot: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Issue lines: low coverage, filled windows, silent sources per topic, and the anomaly total."""
    cols = list(cols or count_columns(pivot))
    per = topic_coverage(pivot, cols)
    lines = [
        F.when(
            F.col("overall_coverage") < 0.3,
            F.format_string("Topic %s: low coverage (%.1f%%)", "topic_id", F.col("overall_coverage") * 100),
        ),
        F.when(
            F.col("filled_windows") > 0,
            F.format_string("Topic %s: %d filled (interpolated/zero-filled) windows", "topic_id", "filled_windows"),
        ),
        *[
            F.when(
                F.col(f"{c.removesuffix('_count')}_coverage") == 0,
                F.format_string(f"Topic %s: no {c.removesuffix('_count')} data", "topic_id"),
            )
            for c in cols
        ],
    ]
    topic_lines = per.select(F.explode(F.array_compact(F.array(*lines))).alias("issue"))
    anomalies = source_coverage(pivot, cols).agg(F.sum("anomaly_count").alias("n")).where("n > 0")
    return topic_lines.unionAll(
        anomalies.select(F.format_string("%d anomaly cells detected (see by_source for breakdown)", "n"))
    )


def quality_score(pivot: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: mean coverage, anomaly penalty (at most 0.2) and the 0-100 score."""
    cols = list(cols or count_columns(pivot))
    coverage = topic_coverage(pivot, cols).agg(F.avg("overall_coverage").alias("avg_coverage"))
    cells = source_coverage(pivot, cols).agg(
        F.sum("anomaly_count").alias("anomaly_cells"), F.sum("total_windows").alias("cells")
    )
    tagged = any(c.endswith("_any_anomaly") for c in pivot.columns)
    penalty = F.least(F.col("anomaly_cells") / F.col("cells"), F.lit(0.2)) if tagged else F.lit(0.0)
    return (
        attach(coverage, cells)
        .withColumn("penalty", F.coalesce(penalty, F.lit(0.0)))
        .withColumn(
            "overall_score",
            F.floor(
                F.greatest(F.lit(0.0), (F.coalesce("avg_coverage", F.lit(0.0)) - F.col("penalty")) * 100)
            ).cast("int"),
        )
    )


def month_windows(spark, start: str, end: str) -> DataFrame:
    """Month catalogue with the end month excluded: start, next month, first and last day."""
    days = F.sequence(
        F.to_date(F.lit(f"{start}-01")), F.add_months(F.to_date(F.lit(f"{end}-01")), -1), F.expr("interval 1 month")
    )
    return (
        spark.range(1)
        .where(F.lit(start) < F.lit(end))
        .select(F.explode(days).alias("d"))
        .select(
            F.date_format("d", "yyyy-MM").alias("window_start"),
            F.date_format(F.add_months("d", 1), "yyyy-MM").alias("window_end"),
            F.date_format("d", "yyyy-MM-dd").alias("first_day"),
            F.date_format(F.last_day("d"), "yyyy-MM-dd").alias("last_day"),
        )
    )
