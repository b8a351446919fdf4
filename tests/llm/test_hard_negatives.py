"""Threshold-algorithm search against scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from risewatch.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, windows string, cell string"


def plain(rows, k=5):
    seen = {}
    for i, vec, label, *_ in rows:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        q = [max(-hn.LARGEST, min(hn.LARGEST, math.floor(256 * float(np.float32(x))))) for x in vec]
        seen[i] = min(seen.get(i, (label, q)), (label, q))
    out = set()
    for a, (la, va) in seen.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (label, v) in seen.items() if i != a)
        for sp, p, _ in [s for s in scored if s[2] == la][:k]:
            good = [s for s in scored if s[2] != la and 80 * -sp <= 100 * -s[0] <= 100 * -sp][:k]
            out |= {(a, p, r, n, -sp, -sn) for r, (sn, n, _) in enumerate(good, 1)}
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    got = [tuple(r) for r in hn.mine(df, "vec_id", "label", "embedding", F.col("id") % 100 == 0).collect()]
    assert len(got) == len(set(got))
    return set(got)


def vectors(seed, n, dims=8, labels=3, spread=0.5):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0.1, spread))) for _ in range(dims)], rng.choice([0, 0, 0, *range(labels)])) for i in range(n)]


@pytest.mark.parametrize("seed,block,group", [(1, 1 << 15, 1 << 16), (2, 90, 2)])
def test_against_all_pairs(spark, monkeypatch, seed, block, group):
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "GROUP", group)
    rows = vectors(seed, 700)
    assert found(spark, rows) == plain(rows)


def test_ties_copies_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 60)
    rng = random.Random(3)
    rows = [(i, [float(rng.choice([0, 1, 2])) / 8 for _ in range(3)], rng.choice([0, 1])) for i in range(-100, 301)]
    rows += [(i, [0.25, 0.25, 0.25], i % 2) for i in range(400, 500)] + rows[:40] + [(100, [0.0, 0.5, 0.0], 7), (100, [0.0, 0.5, 0.0], 7)]
    assert found(spark, rows) == plain(rows)


def test_awkward_vectors(spark):
    rows = vectors(4, 220) + [
        (500, None, 1), (501, [1.0] * 8, None), (None, [1.0] * 8, 1), (502, [1.0, None], 1), (503, [float("nan")] * 8, 0), (504, [float("inf")] * 8, 0),
        (505, [], 0), (600, [0.5, 0.5], 0), (700, [1e30] + [0.0] * 7, 1), (701, [1e30] + [0.5] * 7, 1), (702, [-1e30] * 8, 2), (800, [0.0] * 8, 1), (900, [], 2), (901, [0.5] * 12, 2),
    ]
    assert found(spark, rows) == plain(rows)


def test_empty_and_lonely(spark):
    assert found(spark, []) == set()
    assert found(spark, [(0, [1.0], 1)]) == set()
    assert found(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == set()
    assert found(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]) == {(0, 1, 1, 2, 65536, 58880)}


def test_access_stops_early_and_strictly():
    rng = np.random.default_rng(5)
    vecs = rng.integers(-50, 50, (20_000, 3)).astype(np.int64)
    vecs[:40] = [300, 300, 300]
    lists = hn.Lists(np.arange(20_000)[::-1].copy(), np.zeros(20_000, np.int64), vecs)
    anchor = np.array([2, 1, 3])
    best, met = hn.Best(5), 0
    for rows, scores in lists.meet(anchor, best.done):
        met += len(rows)
        best.offer(lists.ids[rows], scores)
    assert best.ids.tolist() == sorted(lists.ids[:40].tolist())[:5]
    assert met < 1000


def test_types_of_scores():
    for scale in (3, 40_000, 1 << 27):
        vecs = np.array([[scale, -scale], [scale - 1, 1]], np.int64)
        lists = hn.Lists(np.arange(2), np.zeros(2, np.int64), vecs)
        anchor = np.array([scale, scale - 7])
        assert lists.scores(np.arange(2), anchor).tolist() == [int(a) * scale + int(b) * (scale - 7) for a, b in vecs]
