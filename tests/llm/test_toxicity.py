import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_fixtures import prose  # noqa: E402

from risewatch.llm import toxicity as X  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(700):
        words, bad = prose(i, rng.randint(20, 80)).split(), i % 6 == 0
        for _ in range(rng.randint(2, 5) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["zorgu" + rng.choice("abcdef") * 2, "idiot", "vilmork"])
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int"), dict(marks)


def test_held_out_accuracy(corpus):
    docs, labels, marks = corpus
    out = X.score(docs, "text", X.fit(docs, labels)).withColumn("fold", X.checksum(docs["doc_id"])).where("fold = 0").collect()
    good = sum(r["predicted"] == marks[r["doc_id"]] for r in out)
    assert good / len(out) > 0.95 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_held_out_labels_are_never_read(spark, corpus):
    docs, labels, _ = corpus
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (sorted(X.score(docs, "text", X.fit(docs, x)).select("doc_id", "score").collect()) for x in (labels, flipped))
    assert a == b


def test_one_kind_of_label(spark, corpus):
    docs, labels, _ = corpus
    model = X.fit(docs, labels.where("toxic = 0"))
    assert {(r["score"], r["predicted"]) for r in X.score(docs, "text", model).collect()} == {(0.0, 0)}
    assert {r["predicted"] for r in X.score(docs, "text", X.fit(docs, labels.limit(0))).collect()} == {0}


def test_features():
    import pandas as pd

    lexicon = {"bad": [1.0, 2.0, 0.0], "\tzorg": [3.0, 0.0, 0.0]}
    f = X.features(pd.Series(["You are b@d, zorgon! BAD", "", None, "fine words"]), lexicon)
    first = f.iloc[0]
    assert first["lex_n"] == 1 and first["lex_top"] == 2 and first["stem_top"] == 3 and first["near_you"] > 0 and first["masked"] > 0 and first["capitals"] > 0
    assert (f.iloc[1] == 0).all() and (f.iloc[2] == 0).all() and f.iloc[3]["lex"] == 0


def test_isotonic_is_monotone_and_pooled():
    x = list(range(8))
    knots, values = X.isotonic(x, [0, 1, 0, 0, 1, 1, 0, 1], [1] * 8)
    assert knots == sorted(knots) and all(a <= b for a, b in zip(values, values[1:])) and 0 < values[0] < values[-1] < 1
    assert np.interp(1, knots, values) == np.interp(3, knots, values)
