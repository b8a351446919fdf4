"""Shared helpers: global ranks, exact order statistics, top-k."""

import random

import pytest
from pyspark.sql import functions as F

from risewatch.operators import core
from risewatch.operators.fusion import cross_examine, conflicts, rank_normalize
from risewatch.operators import metrics


def test_global_rank_equals_sorted_order_with_heavy_ties(spark):
    rng = random.Random(1)
    rows = [(f"e{i:04d}", 0.0 if rng.random() < 0.4 else float(rng.randrange(30)), i % 3) for i in range(700)]
    df = spark.createDataFrame(rows, "entity string, score double, fold int")
    got = {r.entity: r.rn for r in core.global_rank(df, [F.desc("score"), F.asc("entity")], slices=7).collect()}
    want = {e: i + 1 for i, (e, _, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want
    per = core.global_rank(df, [F.desc("score"), F.asc("entity")], ["fold"], slices=5).collect()
    for fold in range(3):
        ordered = sorted((r for r in rows if r[2] == fold), key=lambda r: (-r[1], r[0]))
        assert {r.entity: r.rn for r in per if r.fold == fold} == {e: i + 1 for i, (e, _, _) in enumerate(ordered)}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 12001])
def test_order_stats_picks_exact_positions(spark, n):
    rng = random.Random(n)
    values = [float(rng.randrange(n)) if rng.random() < 0.7 else 5.0 for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    row = core.order_stats(
        df,
        "value",
        {
            "q1": (0.25, lambda c: F.floor(c / 4)),
            "med": (0.5, lambda c: F.floor(c / 2)),
            "q3": (0.75, lambda c: F.floor(c * 3 / 4)),
        },
    ).first()
    s = sorted(values)
    assert (row.n, row.q1, row.med, row.q3) == (n, s[n // 4], s[n // 2], s[n * 3 // 4])


def test_quantiles_interpolate_per_group(spark):
    import numpy as np

    rng = random.Random(5)
    rows = [(g, rng.random()) for g in ("a", "b") for _ in range(11 if g == "a" else 6000)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = {r.g: (r.q, r.p) for r in core.quantiles(df, "value", {"q": 0.2, "p": 0.75}, ["g"]).collect()}
    for g in ("a", "b"):
        xs = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx((np.quantile(xs, 0.2), np.quantile(xs, 0.75)))


def scores(spark, d):
    return spark.createDataFrame(list(d.items()), "entity string, score double")


def test_rank_normalize(spark):
    got = {r.entity: r.scaled for r in rank_normalize(scores(spark, {"a": 9.0, "b": 1.0, "c": 5.0})).collect()}
    assert got == {"a": 1.0, "c": 0.5, "b": 0.0}
    assert rank_normalize(scores(spark, {"x": 3.0})).first().scaled == 1.0


@pytest.mark.parametrize("weight", [0.5, 0.2])
def test_cross_examination_equals_a_plain_walk(spark, weight):
    rng = random.Random(31)
    left = {f"k{i:02d}": round(rng.random(), 3) for i in range(23)}
    right = {f"k{i:02d}": round(rng.random(), 3) for i in range(9, 40)}

    def scale(d):
        order = sorted(d, key=lambda k: (-d[k], k))
        return {k: (len(d) - 1 - i) / (len(d) - 1) for i, k in enumerate(order)}

    s, t = scale(left), scale(right)
    rows = cross_examine(scores(spark, left), scores(spark, right), weight)
    got = {r.entity: (r.verdict, r.consensus) for r in rows.collect()}
    assert set(got) == set(left) | set(right)
    for k, (verdict, consensus) in got.items():
        high = (s.get(k, 0) >= 0.5, t.get(k, 0) >= 0.5)
        assert verdict == {(True, True): "agree", (True, False): "signal_only", (False, True): "tkg_only", (False, False): "neither"}[high]
        a, b = weight if k in t else 1.0, 1 - weight if k in s else 1.0
        assert consensus == pytest.approx((a * s.get(k, 0) + b * t.get(k, 0)) / (a + b), abs=1e-5)
    assert conflicts(rows).count() == sum(v in ("signal_only", "tkg_only") for v, _ in got.values())


def test_metrics_on_literals(spark):
    ranked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "entity string, pos int")
    truth = spark.createDataFrame([("b",), ("z",)], "entity string")
    pr = metrics.precision_recall(ranked, truth, 10).first()
    assert pr.precision_at_k == pytest.approx(1 / 3) and pr.recall_at_k == 0.5
    empty = spark.createDataFrame([], "entity string, pos int")
    pr = metrics.precision_recall(empty, truth, 10).first()
    assert (pr.precision_at_k, pr.recall_at_k) == (0.0, 0.0)
    rel = spark.createDataFrame([("a", 0.0), ("b", 2.0), ("c", 1.0), ("d", 3.0)], "entity string, rel double")
    import math

    dcg = 0 + 3 / math.log2(3) + 1 / math.log2(4)
    ideal = 7 + 3 / math.log2(3) + 1 / math.log2(4)
    assert metrics.ndcg_at_k(ranked, rel, 5).first().ndcg_at_5 == pytest.approx(dcg / ideal)
    assert metrics.top1_lift(ranked, rel).first().top1_lift == 0.0
    zero = rel.withColumn("rel", F.lit(0.0))
    assert metrics.ndcg_at_k(ranked, zero, 3).first().ndcg_at_3 == 1.0
    assert metrics.top1_lift(ranked, zero).first().top1_lift is None
    big = spark.createDataFrame([("a", 5000.0), ("b", 2500.0)], "entity string, rel double")
    assert 0 < metrics.ndcg_at_k(ranked, big, 3).first().ndcg_at_3 <= 1
    reverse = metrics.spearman(
        scores(spark, {"a": 1.0, "b": 2.0, "c": 3.0}), scores(spark, {"a": 3.0, "b": 2.0, "c": 1.0, "d": 9.0})
    )
    assert reverse.first().spearman_rho == -1.0
    assert metrics.spearman(scores(spark, {"a": 1.0}), scores(spark, {"a": 1.0})).first().spearman_rho == 0.0
    none = spark.createDataFrame([], "actual double, forecast double")
    assert tuple(metrics.regression_errors(none).first()) == (0.0, 0.0, 0.0)
