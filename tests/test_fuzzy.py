"""Fuzzy names with hot pieces against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from risewatch.operators import resolve
from test_graph import lcs

NAMES, ANCHORS = "type string, norm string", "type string, norm string, anchor_entity string, anchor_id string"


def plain(names, anchors, t):
    out = {}
    for x in names:
        for y in anchors:
            s = 2.0 * lcs(x, y) / (len(x) + len(y))
            if s >= t:
                out[x, y] = s
    return out


@pytest.mark.parametrize("threshold,hot", [(0.9, 3), (0.75, 2), (0.5, 1), (0.9, 1000)])
def test_a_piece_in_every_anchor_loses_no_pair(spark, monkeypatch, threshold, hot):
    monkeypatch.setattr(resolve, "HOT_PIECE", hot)
    rng = random.Random(hot)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    anchors = sorted({"deep learning " + word(rng.randrange(1, 9)) for _ in range(50)} | {word(rng.randrange(1, 5)) for _ in range(20)})
    names = set(anchors[::4])
    for a in anchors:
        s = list(a)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(s) + 1)
            if rng.random() < 0.5 and s:
                s.pop(min(at, len(s) - 1))
            else:
                s.insert(at, rng.choice("abc"))
        names.add("".join(s))
    names.discard("")
    n = spark.createDataFrame([("Concept", x) for x in names], NAMES)
    a = spark.createDataFrame([("Concept", x, f"E{x}", f"I{x}") for x in anchors], ANCHORS)
    got = {(r.norm, r.anchor_norm): r.score for r in resolve.fuzzy_pairs(n, a, threshold).collect()}
    want = plain(names, anchors, threshold)
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_hot_piece_is_spread(spark, monkeypatch):
    """All 3,000 anchors begin alike: the piece they share is not entered, and no key keeps more than its share."""
    monkeypatch.setattr(resolve, "HOT_PIECE", 100)
    anchors = spark.range(3000).select(F.lit("Concept").alias("type"), F.concat(F.lit("common words "), F.substring(F.md5(F.col("id").cast("string")), 1, 12)).alias("norm"), F.lit("E").alias("anchor_entity"), F.lit("I").alias("anchor_id"))
    names = anchors.where("norm like '%a'").select("type", "norm")
    found = resolve.fuzzy_pairs(names, anchors)
    assert found.where("norm = anchor_norm").count() == names.count()
