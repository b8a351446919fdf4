import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_fixtures import prose  # noqa: E402

from risewatch.llm import bottom_k as B  # noqa: E402


def grams(text):
    w = text.split()
    return {tuple(w[max(0, i - 4) : i + 1]) for i in range(len(w))}


def test_estimates_are_near_the_truth():
    a = prose(1, 3000)
    b = " ".join([*a.split()[:2000], *prose(2, 1000).split()])
    x, y = B.sketches([a, b])
    true = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    assert abs(B.resemblance(x, y) - true) < 0.12
    assert abs(B.containment(x, y) - len(grams(a) & grams(b)) / len(grams(a))) < 0.15
    assert abs(B.distinct(x) / len(grams(a)) - 1) < 0.3


def test_small_sets_are_exact():
    x, y = B.sketches(["a b c d e f g", "a b c d e f h"])
    assert B.resemblance(x, y) == pytest.approx(6 / 8) and B.distinct(x) == 7 and B.containment(x, y) == pytest.approx(6 / 7)
    empty = B.sketches([""])[0]
    assert B.resemblance(empty, empty) == 1 and B.resemblance(empty, x) == 0 and B.containment(empty, x) == 1


def test_merge_is_the_sketch_of_the_union():
    x, y = B.sketches([prose(1, 900), prose(2, 900)])
    both = B.sketches([prose(1, 900)], k=10**6)[0], B.sketches([prose(2, 900)], k=10**6)[0]
    assert (B.merge(x, y) == np.union1d(*both)[: B.K]).all()


def test_merge_in_spark(spark):
    texts = [prose(i, 400) for i in range(4)]
    docs = spark.createDataFrame([("a", texts[0]), ("a", texts[1]), ("b", texts[2]), ("b", ""), ("c", None)], "g string, text string")
    out = {r["g"]: r["fingerprint"] for r in B.merge_fingerprints(B.fingerprint(docs, "text"), ["g"], "fingerprint").collect()}
    a, b, c, _ = B.sketches(texts)
    assert out == {"a": B.to_hex(B.merge(a, b)), "b": B.to_hex(c), "c": ""}
    assert (B.from_hex(out["a"]) == B.merge(a, b)).all()


@pytest.mark.parametrize("buckets", [1, 3, 8])
def test_edited_pairs(spark, buckets):
    rows = [(i * 7 % 31, prose(i, 5 + 13 * i % 200)) for i in range(31)] + [(None, "z y x w v u"), (100, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r for r in B.edited_pairs(docs, "doc_id", "text", buckets=buckets).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        want = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        x, y, z = B.sketches([t, want, after])
        r = got[k]
        assert r["edited"] == want and r["n_chars"] == len(t) and r["fingerprint"] == B.to_hex(x) and r["edited_fingerprint"] == B.to_hex(y)
        assert r["near_edited"] == B.resemblance(x, y) and r["near_next"] == B.resemblance(x, z)
