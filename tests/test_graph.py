"""Graph, alignment, rules and link ranks against brute force on small data."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from risewatch import schemas as S
from risewatch.operators import extract, generate, graph, links, resolve, rules
from risewatch.plans import backtest


def triples(spark, rows):
    return spark.createDataFrame(
        [(h, "Paper", "belongs_to", t, "Concept", w, "x") for h, t, w in rows], S.TRIPLE
    )


def brute_cooccurrence(rows, least, cap):
    docs, times = {}, {}
    for h, t, w in rows:
        docs.setdefault(h, set()).add(t)
        if w:
            times[h] = min(times.get(h, w), w)
    pairs = Counter(p for cs in docs.values() for p in combinations(sorted(cs), 2))
    kept = {p for p, c in pairs.items() if c >= least}
    deg = Counter(x for p in kept for x in p)
    top = {e for e, _ in sorted(deg.items(), key=lambda kv: (-kv[1], kv[0]))[:cap]}
    out = Counter()
    for d, cs in docs.items():
        if d not in times:
            continue
        for a, b in combinations(sorted(cs), 2):
            if (a, b) in kept and a in top and b in top:
                out[(a, b, times[d])] += 1
                out[(b, a, times[d])] += 1
    return out


@pytest.mark.parametrize("hub_size", [3, 6, 1000])
@pytest.mark.parametrize("least", [1, 2, 3])
def test_cooccurrence_with_hub_documents(spark, hub_size, least):
    rng = random.Random(hub_size * 10 + least)
    rows = []
    for d in range(40):
        size = 25 if d % 13 == 0 else rng.randrange(1, 6)
        when = None if d % 9 == 4 else f"2024-{rng.randrange(1, 13):02d}-01"
        rows += [(f"d{d}", f"c{rng.randrange(30):02d}", when) for _ in range(size)]
    got = graph.project_cooccurrence(triples(spark, rows), min_cooccur=least, max_entities=15, hub_size=hub_size)
    counted = {(r.head, r.tail, r.time): r.n for r in got.groupBy("head", "tail", "time").agg(F.count("*").alias("n")).collect()}
    assert counted == dict(brute_cooccurrence(rows, least, 15))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("threshold", [0.9, 0.8])
def test_fuzzy_pairs_lose_nothing(spark, threshold):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n)).strip() or "a"
    anchors = sorted({word(rng.randrange(1, 24)) for _ in range(60)})
    names = set()
    for a in anchors:
        for _ in range(3):
            s = list(a)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(s) + 1)
                if rng.random() < 0.5 and s:
                    s.pop(min(at, len(s) - 1))
                else:
                    s.insert(at, rng.choice("abc"))
            names.add("".join(s))
    names.discard("")
    n = spark.createDataFrame([("Concept", x) for x in names], "type string, norm string")
    a = spark.createDataFrame([("Concept", x, f"E{x}", f"I{x}") for x in anchors], "type string, norm string, anchor_entity string, anchor_id string")
    got = {(r.norm, r.anchor_norm): r.score for r in resolve.fuzzy_pairs(n, a, threshold).collect()}
    want = {}
    for x in names:
        for y in anchors:
            s = 2.0 * lcs(x, y) / (len(x) + len(y))
            if s >= threshold:
                want[(x, y)] = s
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    best = {r.norm: r.anchor_id[1:] for r in resolve.align_fuzzy(n, a, threshold).collect()}
    for x in {k[0] for k in want}:
        options = [(-v, y) for (nx, y), v in want.items() if nx == x]
        assert best[x] == min(options)[1]


def test_alignment_chain(spark):
    nodes = [
        ("W1", "Paper", "W1", "T", "openalex", "10.1/X."), ("arxiv:1", "Paper", "arxiv:1", "T", "arxiv", " 10.1/x"),
        ("C1", "Concept", "C1", "Deep Learning", "openalex", None), ("t:1", "Technology", None, "deep-learning", "uspto", None),
        ("t:2", "Method", None, "Deep Learnings", "uspto", None), ("p:1", "Person", None, "Deep Learning", "uspto", None),
    ]
    df = spark.createDataFrame(nodes, "id string, type string, entity_id string, name string, source string, doi string")
    got = {r.id: r for r in resolve.align_nodes(df).collect()}
    assert got["arxiv:1"].entity_id == "W1"
    assert got["t:1"].entity_id == "C1" and got["t:1"].type == "Concept" and got["t:2"].anchor_id == "C1"
    assert got["p:1"].entity_id.startswith("person:") and got["p:1"].anchor_id is None
    out = resolve.rewrite_triples(triples(spark, []).unionByName(spark.createDataFrame(
        [("W1", "Paper", "uses", "t:1", "Technology", "2024", "x"), ("W1", "Paper", "uses", "gone", "Method", "2024", "x")], S.TRIPLE
    )), resolve.align_nodes(df)).collect()
    assert [(r.head_id, r.tail_id, r.tail_type) for r in out] == [("W1", "C1", "Concept")]


def facts(spark, seed, n=260, ents=14, rels=("uses", "improves")):
    rng = random.Random(seed)
    rows = [(f"e{min(rng.randrange(ents), rng.randrange(ents)):02d}", rng.choice(rels), f"e{rng.randrange(ents):02d}", f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d}") for _ in range(n)]
    return rows, spark.createDataFrame(rows, "head string, relation string, tail string, time string")


def brute_ranks(train, test, known, score):
    ents = sorted({x for h, _, t, _ in train for x in (h, t)})
    rels = {r for _, r, _, _ in train}
    tails = {}
    for h, r, t, _ in known:
        tails.setdefault((h, r), set()).add(t)
    out = []
    for h, r, t, _ in test:
        if h not in ents or t not in ents or r not in rels:
            continue
        own = score(h, r, t)
        cand = [score(h, r, x) for x in ents if x == t or x not in tails.get((h, r), set())]
        above = sum(c > own + 1e-12 for c in cand)
        ties = sum(abs(c - own) <= 1e-12 for c in cand)
        out.append(above + 1 + (ties - 1) / 2)
    return out


def test_filtered_rank_general_and_closed_form(spark):
    rows, df = facts(spark, 5)
    train, test = rows[:180], rows[180:]
    tr, te = df.limit(0).unionByName(spark.createDataFrame(train, df.schema)), spark.createDataFrame(test, df.schema)
    freq = Counter((h, r, t) for h, r, t, _ in train)
    hist = links.copy_history(tr).withColumn("score", F.col("freq").cast("double"))
    q = links.known_queries(te, tr)
    for known in (test, train + test, []):
        k = links.known_tails(spark.createDataFrame(known, df.schema))
        got = links.filtered_rank(q, hist, k, links.train_entities(tr)).collect()
        want = Counter(brute_ranks(train, test, known, lambda h, r, x: freq.get((h, r, x), 0)))
        ours = Counter()
        for r in got:
            ours[r["rank"]] += r.times
        assert ours == want
    m = links.evaluate_copy_only(tr, te).first()
    ranks = brute_ranks(train, test, train + test, lambda h, r, x: freq.get((h, r, x), 0))
    assert m.mrr == pytest.approx(sum(1 / x for x in ranks) / len(ranks)) and m.n_queries == len(ranks)


def test_blended_ranks_equal_dense_scoring(spark):
    rows, df = facts(spark, 9)
    train, test = rows[:180], rows[180:]
    tr, te = spark.createDataFrame(train, df.schema), spark.createDataFrame(test, df.schema)
    users, items = generate.fit_generate(tr, 4, max_iter=3)
    from risewatch.session import durable

    users, items = durable(users), durable(items)
    u = {r.entity: np.array(r.vec, dtype=float) for r in users.collect()}
    v = {r.entity: np.array(r.vec, dtype=float) for r in items.collect()}
    freq = Counter((h, r, t) for h, r, t, _ in train)
    tot = Counter((h, r) for h, r, _, _ in train)
    z = {h: sum(np.exp(u[h] @ v[x]) for x in v) for h in u}
    score = lambda h, r, x: 0.5 * freq.get((h, r, x), 0) / max(tot.get((h, r), 0), 1) + 0.5 * np.exp(u[h] @ v[x]) / z[h]
    old = generate.BLOCK
    generate.BLOCK = 5
    try:
        got = generate.blend_ranks(links.known_queries(te, tr), tr, (users, items)).collect()
    finally:
        generate.BLOCK = old
    want = Counter(brute_ranks(train, test, train + test, score))
    ours = Counter()
    for r in got:
        ours[r["rank"]] += r.times
        assert r.score == pytest.approx(score(r.head, r.relation, r.tail), abs=1e-6)
    assert ours == want


def test_rules_salted_equal_plain(spark):
    rows, df = facts(spark, 3)
    edges = rules.edge_first(df)
    plain = {r.label: (r.support, r.confidence) for r in rules.mine_transitivity(edges).collect()}
    old = rules.HUB_PATHS
    rules.HUB_PATHS = 3
    try:
        salted = {r.label: (r.support, r.confidence) for r in rules.mine_transitivity(edges).collect()}
    finally:
        rules.HUB_PATHS = old
    first = {}
    for h, r, t, w in rows:
        first[(h, r, t)] = min(w, first.get((h, r, t), w))
    for r1 in ("uses", "improves"):
        for r2 in ("uses", "improves"):
            body, ok = set(), set()
            for (x, a, y), t1 in first.items():
                for (y2, b, z), t2 in first.items():
                    if a == r1 and b == r2 and y == y2 and x != z:
                        body.add((x, z))
                        t3 = first.get((x, r1, z))
                        if t3 and t1 < t3 and t2 < t3:
                            ok.add((x, z))
            assert plain[f"transitivity[{r1},{r2}]"] == salted[f"transitivity[{r1},{r2}]"] == (len(ok), round(len(ok) / len(body), 4) if body else 0.0)


def test_temporal_split_keeps_days_whole(spark):
    rows, df = facts(spark, 4, n=300)
    s = graph.temporal_split(df).collect()
    roles = {}
    for r in s:
        roles.setdefault(r.time, set()).add(r.role)
    assert all(len(v) == 1 for v in roles.values()) and len(s) == 300
    order = {"train": 0, "val": 1, "test": 2}
    seq = [order[next(iter(roles[t]))] for t in sorted(roles)]
    assert seq == sorted(seq)


def test_walk_forward_has_no_leak_and_fallback(spark):
    _, df = facts(spark, 6, n=600)
    folds = backtest.walk_forward(df, backtest.rolling_origins(df, 3))
    assert not any(r.violation for r in backtest.leak_check(folds).collect())
    thin = df.limit(5)
    rows, used, reason = backtest.backtest_links_with_fallback(thin, df, n_splits=3, min_train=50)
    assert used == "cooccur" and reason and rows.count() > 0
    _, used, reason = backtest.backtest_links_with_fallback(df, df, n_splits=3, min_train=50)
    assert used == "directed" and reason is None


def test_record_families(spark):
    pre = spark.createDataFrame([("arxiv:1", "arxiv", "T", None, "a", ["cs.AI"], [("Ann",), ("",)], "2024-01-01")], S.PREPRINT)
    t, n = extract.extract_preprint_triples(pre)
    assert {(r.relation, r.tail) for r in t.collect()} >= {("belongs_to", "cat:cs.AI")} and t.count() == 2
    assert {r.type for r in n.where("entity_id is null").collect()} == {"Author"}
    pat = spark.createDataFrame([("uspto:1", "uspto", "T", "a", ["Org"], ["Ann", "Bo"], "2024-01-01", ["G06N"], "B2")], S.PATENT)
    t, n = extract.extract_patent_triples(pat)
    assert Counter(r.relation for r in t.collect()) == {"belongs_to": 1, "affiliated_with": 1, "authored_by": 2}
    rep = spark.createDataFrame([("github:a/b", "github", "a/b", "d", "u", 5, ["ai"], "2024-01-01")], S.REPO)
    t, n = extract.extract_repo_triples(rep)
    assert t.first().tail == "topic:ai" and n.where("type = 'Repo'").first().stars == 5
    nw = spark.createDataFrame([("gdelt:1", "gdelt", None, "x", "u", ["AI"], ["Ann"], ["Org"], 0.5, "2024-01-01")], S.NEWS)
    t, n = extract.extract_news_triples(nw)
    assert Counter(r.relation for r in t.collect()) == {"belongs_to": 1, "mentions": 2} and n.count() == 4


def test_merge_and_upsert(spark):
    rows = [("a", "Paper", None, None, "s1", None, 1), ("a", "Paper", "a", "Name", "s2", "d", 2), ("a", "Concept", "a", "", None, None, 3), (None, "Paper", None, "x", None, None, 4)]
    df = spark.createDataFrame(rows, "id string, type string, entity_id string, name string, source string, doi string, seq int")
    got = {(r.type, r.id): (r.name, r.source, r.doi) for r in extract.merge_nodes(df, F.col("seq")).collect()}
    assert got == {("Paper", "a"): ("Name", "s1", "d"), ("Concept", "a"): (None, None, None)}
    edges = spark.createDataFrame(
        [("Paper", "a", "uses", "Concept", "b", "2024", "x", 1), ("Paper", "a", "uses", "Concept", "b", None, "y", 2), ("Paper", "a", "likes", "Concept", "b", "1", "y", 3)],
        "head_type string, head_id string, relation string, tail_type string, tail_id string, time string, source string, seq bigint",
    )
    first = graph.upsert_edges(edges, F.col("seq"))
    r = first.collect()
    assert len(r) == 1 and (r[0].time, r[0].source) == (None, "y")
    nodes = spark.createDataFrame([("Paper", "a")], "type string, entity_id string")
    assert tuple(graph.graph_size(nodes, first).first()) == (2, 1)


def largest_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_nodes_that_cannot_fold_stay_out_of_the_joins(spark):
    """Closed nodes have neither a DOI to look up nor a target; as null keys they would share one task (F12)."""
    rows = [(f"p{i}", "Paper", f"p{i}", None, "arxiv", None) for i in range(400)] + [("n1", "Method", None, "Graph Nets", "uspto", None), ("c1", "Concept", "c1", "graph nets", "openalex", None)]
    nodes = spark.createDataFrame(rows, "id string, type string, entity_id string, name string, source string, doi string").repartition(4)
    found = {r.id: r for r in resolve.align_nodes(nodes).collect()}
    assert len(found) == 402 and (found["n1"].entity_id, found["n1"].type, found["n1"].anchor_id) == ("c1", "Concept", "c1") and found["p7"].entity_id == "p7"
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert largest_task(resolve.align_nodes(nodes)) <= 150
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Lines and orders meet in tasks of a bounded number of rows, with the same result (F16, F17, F18, F24, F26)."""
    from risewatch import bindings
    from risewatch.operators import core

    folder = "/root/testdata/sf0.001"
    want = sorted(map(tuple, bindings.directed(spark, folder).collect()))
    monkeypatch.setattr(core, "TASK_ROWS", 100)
    many = bindings.directed(spark, folder)
    rows = bindings.table(spark, folder, "lineitem").count()
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan and f", {-(-rows // 100)}" in plan
    assert sorted(map(tuple, many.collect())) == want


def test_ordered_split_ranks_one_day_only(spark, monkeypatch):
    """Copies, null times and times inside a day; only the day of the cut is ranked (F25)."""
    rng = random.Random(3)
    times = [None, "", "2024-01-01", "2024-01-02T05", "2024-01-02T04", "2024-01-02", "2024-01-03"]
    rows = [(rng.choice("ab"), "r", rng.choice("xy"), rng.choice(times)) for _ in range(300)]
    df = spark.createDataFrame(rows, "head string, relation string, tail string, time string")
    ranked = []
    rank = graph.global_rank
    monkeypatch.setattr(graph, "global_rank", lambda d, *a, **k: ranked.append(d.count()) or rank(d, *a, **k))
    for ratio in (0.0, 0.05, 0.5, 0.8, 1.0):
        order = sorted(rows, key=lambda r: (r[3] is not None, r[3] or "", r[0], r[1], r[2]))
        cut = int(300 * ratio)
        want = sorted(((*r, "train" if i < cut else "test") for i, r in enumerate(order)), key=str)
        assert sorted(map(tuple, graph.ordered_split(df, ratio).collect()), key=str) == want
    assert max(ranked) < 200


def test_merge_meets_equal_rows_once(spark):
    """Repeated node rows are dropped by a hash aggregate before the merge sorts them (F19)."""
    df = spark.range(1000).select(
        F.lit("n").alias("id"), F.lit("Paper").alias("type"), F.when(F.col("id") % 2 == 0, "B").otherwise("A").alias("name"), (F.col("id") % 2).alias("seq")
    )
    out = extract.merge_nodes(df, F.col("seq"))
    assert [tuple(r) for r in out.collect()] == [("n", "Paper", "B", 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2


def test_pairs_meet_candidates_by_document_only(spark):
    """Pairs are joined once; a name with two times gives both, as a join by name did (F22)."""
    c = spark.createDataFrame(
        [("d", "2024", "A", "1"), ("d", "2025", "A", "2"), ("d", "2024", "B", "3"), ("e", "2024", "A", "4")], "doc_id string, time string, name string, concept_id string"
    ).repartition("doc_id")
    pairs = spark.createDataFrame([("d", "A", "B", "uses"), ("e", "A", "B", "uses")], "doc_id string, head string, tail string, relation string")
    out = extract.pairs_to_triples(pairs, c)
    assert sorted((r.head, r.tail, r.time) for r in out.collect()) == [("1", "3", "2024"), ("2", "3", "2025")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
