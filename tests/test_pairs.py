"""Pruned concept pairs against all pairs."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from risewatch.operators import graph, pairs
from risewatch.session import durable


def documents(spark, seed, n=300, names=120):
    rng = random.Random(seed)
    rows = [(f"d{i}", f"c{min(rng.randrange(names), rng.randrange(names))}", "2024-01") for i in range(n) for _ in range(rng.choice([0, 1, 3, 5, 9]))]
    rows = sorted(set(rows))
    return rows, durable(spark.createDataFrame(rows, "doc string, concept string, time string"))


def plain(rows):
    held = {}
    for d, c, _ in rows:
        held.setdefault(d, set()).add(c)
    return Counter(p for cs in held.values() for p in combinations(sorted(cs), 2))


@pytest.mark.parametrize("hub", [256, 5, 0])
@pytest.mark.parametrize("least", [1, 2, 4])
def test_support_equals_all_pairs(spark, monkeypatch, hub, least):
    monkeypatch.setattr(pairs, "CELLS", (1 << 16, 1 << 16))
    rows, docs = documents(spark, hub + least)
    got = {(r.a, r.b): r.n for r in graph.pair_support(docs, least, hub).collect()}
    assert got == {p: n for p, n in plain(rows).items() if n >= least}


def test_crowded_cells_lose_nothing(spark, monkeypatch):
    """With one piece of cells for far more pairs, rare pairs pass the cells and the exact count removes them."""
    rows, docs = documents(spark, 9)
    monkeypatch.setattr(pairs, "pair_cells", lambda a, b, cells, f=pairs.pair_cells: f(a, b, 64))
    got = {(r.a, r.b): r.n for r in graph.pair_support(docs, 3).collect()}
    assert got == {p: n for p, n in plain(rows).items() if n >= 3}


def test_what_is_shuffled_is_close_to_what_stays(spark):
    """4,000 documents with 12 concepts, nearly all pairs seen once: few rows leave the tasks beyond those of kept pairs."""
    rng = random.Random(3)
    rows = [(f"d{i}", sorted([f"c{x:05d}" for x in rng.sample(range(20_000), 10)] + [f"p{i % 50}", f"q{i % 50}"]), "2024-01") for i in range(4000)]
    arrays = durable(spark.createDataFrame(rows, "doc string, concepts array<string>, time string"))
    every = 4000 * 66
    sent = durable(pairs.pairs_in(arrays, pairs.frequent_cells(arrays, 3)))
    kept = sent.groupBy("a", "b").count().where("count >= 3").agg(F.sum("count")).first()[0]
    assert sent.count() - kept < 0.12 * every
    facts = graph.pair_facts(arrays.select("doc", F.explode("concepts").alias("concept"), "time"), spark.createDataFrame([("p1", "q1")], "a string, b string"))
    assert facts.count() == 2 * 80


def test_counts_saturate(spark):
    arrays = durable(spark.createDataFrame([(f"d{i}", ["a", "b"], None) for i in range(700)], "doc string, concepts array<string>, time string"))
    assert pairs.frequent_cells(arrays, 700).sum() == 1
    assert pairs.frequent_cells(arrays.where("false"), 2).sum() == 0


@pytest.mark.parametrize("wide", [4, 12])
@pytest.mark.parametrize("hub", [3, 256])
def test_documents_wider_than_wide_are_looked_up(spark, monkeypatch, wide, hub):
    monkeypatch.setattr(graph, "WIDE", wide)
    rng = random.Random(wide + hub)
    rows = sorted({(f"d{i}", f"c{rng.randrange(40):02d}", "2024-01") for i in range(60) for _ in range(rng.choice([2, 5, 25]))})
    docs = durable(spark.createDataFrame(rows, "doc string, concept string, time string"))
    got = {(r.a, r.b): r.n for r in graph.pair_support(docs, 2, hub).collect()}
    assert got == {p: n for p, n in plain(rows).items() if n >= 2}
    kept = spark.createDataFrame([(a, b) for a, b in got], "a string, b string")
    facts = graph.pair_facts(docs, kept, hub_size=hub).groupBy("head", "tail").count().collect()
    assert {(r.head, r["tail"]): r["count"] for r in facts} == {e: n for (a, b), n in got.items() for e in ((a, b), (b, a))}


def test_repeated_pairs_are_counted_before_the_shuffle(spark):
    """4,000 documents of 7 of 16 concepts on two days, all above the hub size: what leaves the tasks are days x pairs, not documents x pairs."""
    rng = random.Random(4)
    rows = [(f"d{i}", f"c{c:02d}", f"2024-01-0{1 + i % 2}") for i in range(4000) for c in rng.sample(range(16), 7)]
    stored = durable(graph.doc_arrays(spark.createDataFrame(rows, "doc string, concept string, time string")).coalesce(1).sortWithinPartitions("time"))
    arrays, hubs = graph._split_hubs(stored, 4)
    assert hubs.isEmpty()
    sent = durable(pairs.counted_pairs(arrays, timed=True))
    assert sent.agg(F.sum("n")).first()[0] == 4000 * 21
    assert sent.count() <= 8 * 120
