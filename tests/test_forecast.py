"""Fitted forecasts and fold errors against the same model on samples made in plain Python, and against a naive forecast."""

import math
import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from risewatch.catalog import ORACLES, QUERIES
from risewatch.operators import forecast as FC
from risewatch.operators import metrics, series
from risewatch.plans import backtest
from risewatch.session import durable

BINS, LAG, H, GAP, ROUNDS = 30, 6, 6, 6, 3


def dense(seed=1, entities=12):
    rng = random.Random(seed)
    return {f"e{i:02d}": [rng.randint(1, 3) + (i % 4) * (3 + (t % 5)) for t in range(BINS)] for i in range(entities)}


def table(spark, x):
    return spark.createDataFrame([(e, f"{2000 + t // 12}-{t % 12 + 1:02d}", n) for e, v in x.items() for t, n in enumerate(v)], "entity string, bin string, cnt bigint")


def fitted(spark, x, last, t0):
    """entity -> (forecast, actual) of the model fit on all samples whose label ends at or before ``last``."""
    label = lambda v, t: sum(v[t : t + H]) / H
    train = [(Vectors.dense(v[t - LAG : t]), label(v, t)) for v in x.values() for t in range(LAG, BINS) if t + H <= last]
    test = [(e, Vectors.dense(v[t0 - LAG : t0]), label(v, t0)) for e, v in x.items()]
    model = GBTRegressor(featuresCol="fv", labelCol="label", predictionCol="forecast", maxIter=ROUNDS, seed=42).fit(spark.createDataFrame(train, ["fv", "label"]).coalesce(1))
    return {r["entity"]: (r["forecast"], r["actual"]) for r in model.transform(spark.createDataFrame(test, ["entity", "fv", "actual"])).collect()}


def errors(pairs):
    d = [(abs(a - p), a) for p, a in pairs]
    return [sum(e for e, _ in d) / len(d), math.sqrt(sum(e * e for e, _ in d) / len(d)), sum(e / a for e, a in d) / len(d)]


def test_forecast_like_the_plain_samples(spark):
    x = dense()
    got = {r["entity"]: r for r in FC.forecast(table(spark, x), max_iter=ROUNDS).collect()}
    want = fitted(spark, x, BINS - H, BINS - H)
    assert set(got) == set(x)
    for e, (p, a) in want.items():
        assert got[e]["forecast"] == pytest.approx(p, abs=1e-6) and got[e]["actual"] == pytest.approx(a, abs=1e-9)
    overall = sum(map(sum, x.values())) / (BINS * len(x))
    assert errors([(r["forecast"], r["actual"]) for r in got.values()])[0] < 0.3 * errors([(overall, r["actual"]) for r in got.values()])[0]
    assert len({round(r["forecast"], 6) for r in got.values()}) > 3


def plain_folds(spark, x):
    for t0 in range(BINS - H - 4, BINS - H + 1):
        yield t0, errors(fitted(spark, x, t0 - GAP - 1, t0).values())


def test_fold_errors_like_the_plain_samples(spark):
    x = dense(2)
    got = backtest.backtest_regression(table(spark, x), max_iter=ROUNDS).orderBy("t0").collect()
    want = list(plain_folds(spark, x))
    assert [r["t0"] for r in got] == [t0 for t0, _ in want] and [r["fold"] for r in got] == list(range(5))
    for r, (_, e) in zip(got, want):
        assert [r["mae"], r["rmse"], r["mape"]] == pytest.approx(e, abs=1e-6)


def test_citation_report_has_folds_beside_curves(spark):
    x = dense(3, 6)
    cites = [(e, "cited_by", f"c{e}{t}{i}", f"{2000 + t // 12}-{t % 12 + 1:02d}-05") for e, v in x.items() for t, n in enumerate(v) for i in range(n)]
    facts = spark.createDataFrame(cites, "head string, relation string, tail string, time string")
    rows = backtest.citation_report_rows(facts, max_iter=ROUNDS).collect()
    running = {e: [sum(v[: t + 1]) for t in range(BINS)] for e, v in x.items()}
    want = list(plain_folds(spark, running))
    got = sorted((r for r in rows if r["part"] == "regression"), key=lambda r: r["t0"])
    assert [r["t0"] for r in got] == [t0 for t0, _ in want]
    for r, (_, e) in zip(got, want):
        assert [r["mae"], r["rmse"], r["mape"]] == pytest.approx(e, abs=1e-6)
    curves = sorted((r["stage_order"], r["bin"], r["level"]) for r in rows if r["part"] == "curve")
    assert curves == sorted((r["stage_order"], r["bin"], r["level"]) for r in backtest.citation_stages(facts)[1].collect())


def test_fitted_columns_are_registered():
    names = {"bt_03_regression_errors", "bt_04_forecast_values", "bt_06_citation_report"}
    assert names <= set(QUERIES) and not names & set(ORACLES)


def test_running_arrays_are_arrays_of_running_totals(spark):
    rng = random.Random(5)
    cells = [(f"e{i}", f"2001-{b:02d}", rng.randint(1, 4)) for i in range(6) for b in range(1, 13) if rng.random() < 0.4 or (i, b) in ((0, 1), (1, 12))]
    counts = durable(spark.createDataFrame(cells, "entity string, bin string, cnt bigint"))
    summed = series.cumulate(counts).select("entity", "bin", F.col("cum").alias("cnt"))
    want, got = ({r["entity"]: (r["n"], r["x"]) for r in a.collect()} for a in (series.series_arrays(durable(summed)), series.running_arrays(counts)))
    assert got == want


def test_equal_samples_are_fitted_once(spark, monkeypatch):
    """40 copies of each entity: the model sees no more rows than for one, and gives the same forecasts."""
    x = dense(6, 4)
    copies = {f"{e}:{c}": v for e, v in x.items() for c in range(40)}
    seen, stored = [], FC.durable
    monkeypatch.setattr(FC, "durable", lambda df: seen.append(stored(df)) or seen[-1])
    one, many = ({r["entity"]: r["forecast"] for r in FC.forecast(table(spark, t), max_iter=ROUNDS).collect()} for t in (x, copies))
    assert seen[1].count() == seen[0].count()
    assert many == pytest.approx({f"{e}:{c}": one[e] for e in x for c in range(40)}, abs=1e-6)


def test_folds_read_equal_samples_once(spark, monkeypatch):
    """32 copies of each entity (a power of two keeps equal gains equal): every fold fits and forecasts as few rows as for one."""
    x = dense(7, 4)
    seen, fit = [], backtest.F_.fit_fold
    monkeypatch.setattr(backtest.F_, "fit_fold", lambda train, test, *a: seen.append((train.count(), test.count())) or fit(train, test, *a))
    copies = {f"{e}:{c}": v for e, v in x.items() for c in range(32)}
    one, many = (backtest.backtest_regression(table(spark, t), max_iter=ROUNDS).orderBy("t0").collect() for t in (x, copies))
    assert len(seen) == 10 and seen[5:] == seen[:5]
    for a, b in zip(one, many):
        assert tuple(b) == pytest.approx(tuple(a), abs=1e-6)


def test_counted_samples_are_those_of_each_fold(spark):
    """Bins may serve a late fold for training and an early one as its test."""
    x = dense(8, 5)
    arrays, starts = durable(series.series_arrays(table(spark, x))), [12, 15, 21]
    rows = FC.counted_samples(arrays, starts, 3, 2, 1).collect()
    for i, t0 in enumerate(starts):
        spots = {False: range(3, t0 - 3), True: [t0]}
        for test, ts in spots.items():
            want = sorted((tuple(v[t - 3 : t]), (v[t] + v[t + 1]) / 2) for v in x.values() for t in ts)
            use = [r for r in rows if r["test"] == test and (r["fold"] == i if test else r["fold"] <= i)]
            assert sorted(s for r in use for s in [(tuple(r["features"]), r["label"])] * int(r["weight"])) == want


def test_folds_of_the_most_active_entities(spark):
    x = dense(9, 6)
    top = sorted(x, key=lambda e: -sum(x[e][: BINS - H - 4]))[:2]
    got, want = (backtest.backtest_regression(table(spark, t), k=k, max_iter=ROUNDS).orderBy("t0").collect() for t, k in ((x, 2), ({e: x[e] for e in top}, None)))
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r), abs=1e-6) for r in want] and len(got) == 5


def test_weighted_errors_are_those_of_repeated_rows(spark):
    rows = [(0.0, 1.0, 2.0), (4.0, 1.0, 3.0), (5.0, 5.5, 1.0)]
    plain = spark.createDataFrame([(a, p) for a, p, n in rows for _ in range(int(n))], "actual double, forecast double")
    counted = spark.createDataFrame(rows, "actual double, forecast double, weight double")
    assert tuple(metrics.regression_errors(counted, weight="weight").first()) == pytest.approx(tuple(metrics.regression_errors(plain).first()))
    assert tuple(metrics.regression_errors(counted.limit(0), weight="weight").first()) == (0.0, 0.0, 0.0)


def test_model_does_not_follow_the_order_of_rows(spark):
    """Above 10,000 rows the fit draws its split bins from a sample of them."""
    rng = random.Random(10)
    rows = [([float(rng.randint(0, 60)) for _ in range(LAG)], rng.random() * 60) for _ in range(14_000)]
    test = spark.createDataFrame([(f"e{i}", r[0], r[1]) for i, r in enumerate(rows[:50])], "entity string, features array<double>, label double")
    fits = []
    for parts in (1, 5):
        rng.shuffle(rows)
        train = spark.createDataFrame(rows, "features array<double>, label double").repartition(parts)
        fits.append({r["entity"]: r["forecast"] for r in FC.fit_fold(train, test, 2).collect()})
    assert fits[0] == pytest.approx(fits[1], abs=1e-9)
