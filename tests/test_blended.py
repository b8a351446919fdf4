"""Fold-keyed factors, blended ranks and blended link scores against dense plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from risewatch.operators import factors, fusion, generate, links
from risewatch.plans import backtest, collaborate, predict
from risewatch.session import durable


def facts(spark, seed, n, folds=(0, 1), names=14):
    rng = random.Random(seed)
    pick = lambda: f"e{min(rng.randrange(names), rng.randrange(names)):02d}"
    rows = [(f, pick(), rng.choice(["uses", "improves"]), pick()) for f in folds for _ in range(n)]
    return rows, spark.createDataFrame(rows, "fold int, head string, relation string, tail string")


def plain_als(rows, first, dim, iters, reg=0.1):
    """Users and items of one fold by normal equations over the whole dense matrix."""
    c = Counter((h, t) for _, h, _, t in rows)
    heads, tails = sorted({h for h, _ in c}), sorted({t for _, t in c})
    m = np.array([[c.get((h, t), 0) for t in tails] for h in heads], float)
    v, u = np.array([first[t] for t in tails]), None

    def solve(counts, other):
        out = []
        for row in counts:
            a = other.T @ other + (other * row[:, None]).T @ other + reg * (row > 0).sum() * np.eye(dim)
            out.append(np.linalg.solve(a, ((1 + row) * (row > 0)) @ other))
        return np.array(out)

    for _ in range(iters):
        u = solve(m, v)
        v = solve(m.T, u)
    return dict(zip(heads, u)), dict(zip(tails, v))


@pytest.mark.parametrize("split", [4096, 5])
def test_factors_of_all_folds_equal_plain_ones(spark, monkeypatch, split):
    monkeypatch.setattr(factors, "SPLIT", split)
    rows, df = facts(spark, 1, 120)
    names = spark.createDataFrame([(f"e{i:02d}",) for i in range(14)], "entity string")
    first = {r.entity: np.array(r.vec) for r in factors.start(names, 3, 42).collect()}
    users, items = factors.fit_factors(df, ["fold"], dim=3, max_iter=3)
    for fold in (0, 1):
        u, v = plain_als([r for r in rows if r[0] == fold], first, 3, 3)
        for got, want in ((users, u), (items, v)):
            found = {r.entity: np.array(r.vec) for r in got.where(F.col("fold") == fold).collect()}
            assert set(found) == set(u) | set(v)
            for e, vec in found.items():
                assert vec == pytest.approx(want.get(e, np.zeros(3)), abs=1e-8)


def test_factors_of_nothing(spark):
    users, items = factors.fit_factors(spark.createDataFrame([], "head string, relation string, tail string"), dim=2)
    assert users.count() == items.count() == 0


def dense(train, u, v, alpha=0.5):
    ents = sorted({x for _, h, _, t in train for x in (h, t)})
    freq, tot = Counter((h, r, t) for _, h, r, t in train), Counter((h, r) for _, h, r, _ in train)
    z = {h: sum(np.exp(u[h] @ v[x]) for x in ents) for h in ents}
    return ents, lambda h, r, x: alpha * freq.get((h, r, x), 0) / max(tot.get((h, r), 0), 1) + (1 - alpha) * np.exp(u[h] @ v[x]) / z[h]


def plain_ranks(train, test, score, ents):
    known = {(h, r, t) for _, h, r, t in train + test}
    rels = {r for _, _, r, _ in train}
    out = []
    for _, h, r, t in test:
        if h in ents and t in ents and r in rels:
            own = score(h, r, t)
            others = [score(h, r, x) for x in ents if x != t and (h, r, x) not in known]
            tie = sum(abs(s - own) < 1e-12 for s in others)
            out.append(sum(s > own + 1e-12 for s in others) + 1 + tie / 2)
    return out


@pytest.mark.parametrize("block", [2048, 4])
def test_ranks_of_all_folds_equal_dense_ones(spark, monkeypatch, block):
    monkeypatch.setattr(generate, "BLOCK", block)
    train, tr = facts(spark, 2, 90)
    test, te = facts(spark, 3, 40, names=16)
    pair = tuple(durable(f) for f in factors.fit_factors(tr, ["fold"], dim=3, max_iter=2))
    got = generate.blend_ranks(links.known_queries(te, tr, ["fold"]), tr, pair, 0.5, ["fold"]).collect()
    for fold in (0, 1):
        u, v = ({r.entity: np.array(r.vec) for r in f.where(F.col("fold") == fold).collect()} for f in pair)
        mine = [r for r in train if r[0] == fold]
        ents, score = dense(mine, u, v)
        want = Counter(plain_ranks(mine, [r for r in test if r[0] == fold], score, set(ents)))
        ours = Counter()
        for r in got:
            if r.fold == fold:
                ours[r["rank"]] += r.times
                assert r.score == pytest.approx(score(r.head, r.relation, r.tail))
        assert ours == want


@pytest.mark.parametrize("block", [2048, 3])
def test_future_link_scores_are_dense_column_means(spark, monkeypatch, block):
    monkeypatch.setattr(generate, "BLOCK", block)
    train, tr = facts(spark, 4, 80)
    test, te = facts(spark, 5, 30, names=18)
    pair = tuple(durable(f) for f in factors.fit_factors(tr, ["fold"], dim=3, max_iter=2))
    got = generate.future_link_scores(links.copy_history(tr, ["fold"]), te, pair, "uses", by=["fold"]).collect()
    for fold in (0, 1):
        u, v = ({r.entity: np.array(r.vec) for r in f.where(F.col("fold") == fold).collect()} for f in pair)
        ents, score = dense([r for r in train if r[0] == fold], u, v)
        heads = {h for f, h, _, _ in test if f == fold and h in ents}
        want = {x: np.mean([score(h, "uses", x) for h in heads]) for x in ents}
        assert {r.entity: r.score for r in got if r.fold == fold} == pytest.approx(want)
    nobody = generate.future_link_scores(links.copy_history(tr, ["fold"]), te.where("false"), pair, by=["fold"])
    assert nobody.count() == 0


def test_blocks_meet_blocks_on_5000_by_5000(spark):
    """What is moved grows with heads / BLOCK: nine pairs of blocks, not an entity block for each of 5,000 heads."""
    rng = np.random.default_rng(6)
    u, v = rng.normal(size=(5000, 4)), rng.normal(size=(5000, 4))
    table = lambda m: durable(spark.createDataFrame([(f"x{i}", x.tolist()) for i, x in enumerate(m)], "entity string, vec array<double>"))
    users, items = table(u), table(v)
    keyed = lambda df: df.withColumn("_g", F.lit(""))
    pairs = generate._pairs(generate._blocks(keyed(users), "_h", "entity", "vec"), keyed(items))
    assert pairs.count() == 9
    edges = spark.createDataFrame([(f"x{i}", "uses", f"x{(i * 7 + 1) % 5000}") for i in range(5000)], "head string, relation string, tail string")
    train = edges.limit(0).unionByName(spark.createDataFrame([("x0", "uses", "x9")], edges.schema))
    ranks = {r["head"]: r["rank"] for r in generate.blend_ranks(edges, train, (users, items)).collect()}
    assert len(ranks) == 5000
    logits = u @ v.T
    for i in range(1, 5000, 50):
        assert ranks[f"x{i}"] == (logits[i] > logits[i, (i * 7 + 1) % 5000]).sum() + 1


def test_blended_backtest(spark):
    """Folds, factors, ranks and metrics together against the plain chain."""
    rng = random.Random(7)
    rows = [(f"e{rng.randrange(9)}", "uses", f"e{rng.randrange(9)}", f"2024-{rng.randrange(1, 9):02d}-{rng.randrange(1, 28):02d}") for _ in range(500)]
    df = spark.createDataFrame(rows, "head string, relation string, tail string, time string")
    got = {r.fold: r for r in backtest.backtest_blended_links(df, n_splits=2, min_train=50, dim=3, max_iter=2).collect()}
    copied = {r.fold: r for r in backtest.backtest_links(df, n_splits=2, min_train=50).collect()}
    assert set(got) == set(copied) == {0, 1}
    names = spark.createDataFrame([(f"e{i}",) for i in range(9)], "entity string")
    first = {r.entity: np.array(r.vec) for r in factors.start(names, 3, 42).collect()}
    for fold, month in ((0, 7), (1, 8)):
        train = [(0, h, r, t) for h, r, t, w in rows if int(w[5:7]) < month - 1]
        test = [(0, h, r, t) for h, r, t, w in rows if int(w[5:7]) == month]
        u, v = plain_als(train, first, 3, 2)
        ents, score = dense(train, u, v)
        ranks = plain_ranks(train, test, score, set(ents))
        r = got[fold]
        assert (r.n_train, r.n_test) == (len(train), len(test))
        assert r.blended_mrr == pytest.approx(np.mean([1 / x for x in ranks]))
        assert r.blended_hits_at_3 == pytest.approx(np.mean([x <= 3 for x in ranks]))
        assert (r.copy_mrr, r.copy_hits_at_1) == (copied[fold].mrr, copied[fold].hits_at_1)


def test_fusion_baseline_reads_blended_scores(spark):
    """The fusion leg: rank scaling, weights and precision of the blended scores by hand."""
    rng = random.Random(8)
    names = [f"e{i}" for i in range(8)]
    rows = [(rng.choice(names), "relates_to", rng.choice(names), f"2024-{m:02d}-{rng.randrange(1, 28):02d}") for m in range(1, 13) for _ in range(15)]
    tkg = {r.entity: r.score for r in collaborate.blended_link_scores(spark.createDataFrame(rows, "head string, relation string, tail string, time string"), dim=3, max_iter=2).collect()}
    assert sum(tkg.values()) == pytest.approx(1.0) and min(tkg.values()) > 0  # a mean of distributions
    counts = [(e, f"2024-{m:02d}", rng.randrange(1, 9)) for e in names for m in range(1, 13)]
    cdf = durable(spark.createDataFrame(counts, "entity string, bin string, cnt bigint"))
    forecast = {e: rng.random() for e in names}
    frame = lambda d: durable(spark.createDataFrame(list(d.items()), "entity string, score double"))
    row = predict.baselines(cdf, 3, 3, ("fusion",), frame(tkg), frame(forecast)).first()
    from risewatch.operators.series import growth_topk, share_momentum

    momentum = {r.entity: r.score for r in share_momentum(cdf, holdout=3).collect()}

    def scaled(d):
        order = sorted(d, key=lambda e: (-d[e], e))
        return {e: 1 - i / (len(order) - 1) for i, e in enumerate(order)}

    parts = [scaled(momentum), scaled(tkg), scaled(forecast)]
    total = {e: 0.3 * parts[0].get(e, 0) + 0.4 * parts[1].get(e, 0) + 0.3 * parts[2].get(e, 0) for e in names}
    best = sorted(total, key=lambda e: (-total[e], e))[:3]
    truth = [r.entity for r in growth_topk(cdf, 3, 3).collect()]
    assert row.precision_at_k == pytest.approx(len(set(best) & set(truth)) / 3)
    assert [r.entity for r in fusion.fuse(share_momentum(cdf, holdout=3), frame(tkg), frame(forecast), k=3).orderBy("pos").collect()] == best


def test_counted_facts_score_like_repeated_ones(spark):
    rng = random.Random(9)
    rows = [(f"e{rng.randrange(7)}", "relates_to", f"e{rng.randrange(7)}", f"2024-{rng.randrange(1, 13):02d}-01") for _ in range(400)]
    plain = spark.createDataFrame(rows, "head string, relation string, tail string, time string")
    counted = plain.groupBy("head", "relation", "tail", "time").agg(F.count("*").alias("n"))
    assert counted.count() < 400
    for score in (collaborate.link_scores, lambda f: collaborate.blended_link_scores(f, dim=3, max_iter=2)):
        want, got = ({r.entity: r.score for r in score(f).collect()} for f in (plain, counted))
        assert got == pytest.approx(want)


def test_backtest_of_counted_facts(spark):
    rng = random.Random(10)
    rows = [(f"e{rng.randrange(6)}", "uses", f"e{rng.randrange(6)}", f"2024-{rng.randrange(1, 9):02d}-01") for _ in range(500)]
    plain = durable(spark.createDataFrame(rows, "head string, relation string, tail string, time string"))
    counted = durable(plain.groupBy("head", "relation", "tail", "time").agg(F.count("*").alias("n")))
    assert counted.count() < 400
    want, got = (sorted(backtest.backtest_blended_links(f, n_splits=2, min_train=50, dim=3, max_iter=1).collect()) for f in (plain, counted))
    assert len(got) == len(want) == 2
    for a, b in zip(got, want):
        assert [x for x in a] == [pytest.approx(y) if isinstance(y, float) else y for y in b]
