"""Queries over regression samples, forecasts and the blended link model."""

from __future__ import annotations

from pyspark.sql import functions as F

from risewatch.catalog import graphs
from risewatch.catalog.registry import DENSE, query
from risewatch.catalog.series import CITE_DENSE, CURVE, STAGES, counts, facts, r6
from risewatch.operators import forecast as FC
from risewatch.operators import generate, links, series
from risewatch.plans import backtest

LAGGED = DENSE + """, lagged AS (SELECT entity, ord - 1 AS t, n, lag(x, 3) OVER w AS lag_1, lag(x, 2) OVER w AS lag_2, lag(x, 1) OVER w AS lag_3,
    avg(x) OVER (PARTITION BY entity ORDER BY ord ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS y FROM dense WINDOW w AS (PARTITION BY entity ORDER BY ord))"""


@query("win_16_lag_features", f"WITH {LAGGED} SELECT entity, t::INT AS t, lag_1, lag_2, lag_3 FROM lagged WHERE t >= 3")
def _(spark, d):
    return FC.lag_features(counts(spark, d), 3)


@query("win_17_horizon_label", f"WITH {LAGGED} SELECT entity, t::INT AS t, round(y, 6) AS label FROM lagged WHERE t + 6 <= n")
def _(spark, d):
    return FC.horizon_label(counts(spark, d), 6).withColumn("label", r6("label"))


@query(
    "win_18_purged_samples",
    f"WITH {LAGGED} SELECT entity, t::INT AS t, round(y, 6) AS label FROM lagged WHERE t >= 6 AND t + 6 < 70 - 6",
)
def _(spark, d):
    samples = FC.lag_samples(series.series_arrays(counts(spark, d)))
    return FC.purge(samples, 70).select("entity", "t", r6("label"))


@query(
    "win_20_regression_origins",
    f"WITH {DENSE} SELECT f::INT AS fold, max(n) AS n_bins, max(n) - 6 - (4 - f) AS t0 FROM bins CROSS JOIN range(5) r(f) GROUP BY f",
)
def _(spark, d):
    return backtest.regression_origins(series.bin_axis(counts(spark, d)))


@query(
    "bt_03_fold_samples",
    f"""WITH {LAGGED}
    SELECT l.entity, t::INT AS t, round(y, 6) AS label, CASE WHEN t = 70 THEN 'test' ELSE 'train' END AS role FROM lagged l
    WHERE (t >= 6 AND t + 6 < 70 - 6) OR t = 70""",
)
def _(spark, d):
    train, test = FC.regression_fold(counts(spark, d), 70)
    pick = lambda df, r: df.select("entity", "t", r6("label"), F.lit(r).alias("role"))
    return pick(train, "train").unionByName(pick(test, "test"))


# The errors and forecasts of fitted trees are beyond SQL: the queries with SQL hold the exact columns, those without
# return the fitted ones, which tests/test_forecast.py holds against plain versions.
@query("bt_03_regression_errors")
def _(spark, d):
    return backtest.backtest_regression(counts(spark, d)).select("fold", F.col("t0").cast("int"), "mae", "rmse", "mape")


@query(
    "bt_03_regression_backtest",
    f"WITH {DENSE} SELECT f::INT AS fold, (max(n) - 6 - (4 - f))::INT AS t0, true AS has_errors FROM bins CROSS JOIN range(5) r(f) GROUP BY f",
)
def _(spark, d):
    return backtest.backtest_regression(counts(spark, d)).select("fold", F.col("t0").cast("int"), ((F.col("mae") >= 0) & (F.col("rmse") >= F.col("mae"))).alias("has_errors"))


@query("bt_04_forecast_values")
def _(spark, d):
    return FC.forecast(counts(spark, d))


@query(
    "bt_04_forecast",
    f"""WITH {DENSE} SELECT entity, round(avg(x) FILTER (ord BETWEEN n - 11 AND n - 6), 6) AS recent_mean, round(avg(x) FILTER (ord > n - 6), 6) AS actual,
      true AS has_forecast FROM dense GROUP BY entity""",
)
def _(spark, d):
    out = FC.forecast(counts(spark, d))
    return out.select("entity", r6("recent_mean"), r6("actual"), F.col("forecast").isNotNull().alias("has_forecast"))


@query("bt_06_citation_stage_report", f"WITH {CITE_DENSE}{STAGES}{CURVE}")
def _(spark, d):
    return backtest.citation_stages(facts(spark, d))[1].select("stage_order", "stage", "bin", r6("level"))


@query("bt_06_citation_report")
def _(spark, d):
    return backtest.citation_report_rows(facts(spark, d))


@query("grf_17_blended_ranks")
def _(spark, d):
    train, test = graphs.parts(spark, d)
    known = links.known_queries(test, train)
    return generate.blend_ranks(known, train, generate.fit_generate(train))
