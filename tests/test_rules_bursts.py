"""Transitivity rules around hubs, and bursts over long series and from SQL."""

import random
import time

import pytest
from pyspark.sql import functions as F

from risewatch.functions import sql
from risewatch.operators import bursts, rules
from test_series import plain_bursts, table

EDGES = "head string, relation string, tail string, time string"


def plain_transitivity(rows):
    first = {}
    for h, r, t, w in rows:
        first[h, r, t] = min(w, first.get((h, r, t), w))
    rels, out = sorted({r for _, r, _ in first}), {}
    for r1 in rels:
        for r2 in rels:
            body, ok = set(), set()
            for (x, a, y), t1 in first.items():
                for (y2, b, z), t2 in first.items():
                    if a == r1 and b == r2 and y == y2 and x != z:
                        body.add((x, z))
                        t3 = first.get((x, r1, z))
                        if t3 and t1 < t3 and t2 < t3:
                            ok.add((x, z))
            out[f"transitivity[{r1},{r2}]"] = (len(ok), round(len(ok) / len(body), 4) if body else 0.0)
    return out


@pytest.mark.parametrize("hub,seed", [(0, 1), (3, 2), (40, 3), (10_000, 4)])
def test_heavy_and_light_middles_equal_plain(spark, monkeypatch, hub, seed):
    """Loops, repeated edges, shared middles; any bound between listing nothing and listing all gives the same rules."""
    monkeypatch.setattr(rules, "HUB_PATHS", hub)
    rng = random.Random(seed)
    pick = lambda: f"e{min(rng.randrange(12), rng.randrange(12))}"
    rows = [(pick(), rng.choice("abc"), pick(), f"2024-{rng.randrange(1, 9):02d}") for _ in range(150)]
    got = rules.mine_transitivity(rules.edge_first(spark.createDataFrame(rows, EDGES))).collect()
    assert {r.label: (r.support, r.confidence) for r in got} == plain_transitivity(rows)


def test_star_of_100_000_edges(spark):
    """50,000 edges into one node and 50,000 out of it: 2.5 billion paths, counted without listing them."""
    n = 50_000
    ids = spark.range(n)
    into = ids.select(F.concat(F.lit("x"), "id").alias("head"), F.lit("r").alias("relation"), F.lit("hub").alias("tail"), F.lit("2024-01").alias("time"))
    away = ids.select(F.lit("hub").alias("head"), F.lit("r").alias("relation"), F.concat(F.lit("z"), "id").alias("tail"), F.lit("2024-02").alias("time"))
    close = ids.where("id < 10").select(F.concat(F.lit("x"), "id").alias("head"), F.lit("r").alias("relation"), F.concat(F.lit("z"), "id").alias("tail"), F.lit("2024-03").alias("time"))
    edges = into.unionByName(away).unionByName(close)
    (row,) = rules.mine_transitivity(edges).collect()
    assert row.support == 10 and row.confidence == round(10 / n**2, 4)
    assert rules._bodies(edges, rules._heavy(edges)).first().body == n**2


def test_bursts_of_10_000_bins(spark):
    """Time is linear in the bins: ten times the bins may not take much more than ten times as long."""
    rng = random.Random(5)
    short, long = ([rng.choice([0, 1, 2, 3]) + 15 * ((t // 50) % 9 == 0) for t in range(n)] for n in (1000, 10_000))
    took = []
    for x in (short, long):
        df = spark.createDataFrame([([float(v) for v in x],)], "x array<double>")
        found = df.select(F.expr(bursts.burst_sql("x", "size(x)", "2D", "1D")).alias("b"))
        found.collect()
        start = time.time()
        got = found.first().b
        took.append(time.time() - start)
        assert [tuple(b) for b in got] == plain_bursts(x) and len(got) > 1
    assert took[1] < 30 * max(took[0], 0.1)


def test_sql_functions_equal_the_operator(spark):
    sql.register(spark)
    rng = random.Random(6)
    data = {f"e{i}": [rng.choice([0, 1, 1, 2, 14]) for _ in range(24)] for i in range(12)} | {"none": [0] * 23 + [1]}
    want = {(r.entity, r.start, r.end, r.weight) for r in bursts.kleinberg_bursts(table(spark, data)).collect()}
    spark.createDataFrame([(e, [float(v) for v in x]) for e, x in data.items()], "entity string, x array<double>").createOrReplaceTempView("burst_input")
    rows = spark.sql("SELECT entity, b.* FROM burst_input, LATERAL burst_rows(x, 2D, 1D) AS b").collect()
    assert {tuple(r) for r in rows} == want
    flat = spark.sql("SELECT entity, inline(b) FROM (SELECT entity, burst_array(x, 2D, 1D) AS b FROM burst_input)").collect()
    assert {tuple(r) for r in flat} == want
