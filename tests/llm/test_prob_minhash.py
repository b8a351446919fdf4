import random
from collections import Counter, defaultdict

import numpy as np

from risewatch.llm import prob_minhash as M


def copies(seed, groups=6, size=12, words=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8)))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                own[rng.randrange(words)] = word()
            out.append(" ".join(own))
    out += ["", None, "   ", "one two", "one two", "one  two", "one two three"]
    rng.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)]


def shingle_bag(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)] if w else [])


def probability_jaccard(x, y):
    """By the definition, over all elements for each common one."""
    both = [(x[j], y[j]) for j in x | y]
    return sum(1 / sum(max(m / x[i], n / y[i]) for m, n in both) for i in x & y)


def plain(rows, least=0.8):
    bags = [shingle_bag(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or probability_jaccard(bags[i], bags[j]) >= least - 1e-9:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return {k: min(v) for v in groups.values() for k in v}


def test_classes_like_all_pairs(spark):
    for seed in (1, 2):
        rows = copies(seed)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
        assert {r["id"]: r["class_id"] for r in M.classes(docs, "doc_id", "text").collect()} == plain(rows)


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    rows = copies(3, groups=2, size=30)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["id"]: r["class_id"] for r in M.classes(docs, "doc_id", "text").collect()} == plain(rows)


def test_keep_first(spark):
    rows = copies(4) + [(None, "alone without an id at all here"), (0, "x"), (0, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'k' AS at", "'k' AS class_id")
    kept = M.keep_first(docs, "doc_id", "text").collect()
    known = [r for r in rows if r[0] is not None]
    want = sorted({r: 0 for r in known if plain(known)[r[0]] == r[0]} , key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in kept if r["doc_id"] is not None), key=str) == want
    assert sum(r["doc_id"] is None for r in kept) == 1


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    names = rng.integers(1, 2**63, 300).astype(np.uint64)
    x, y = rng.integers(0, 4, 300).astype(float), rng.integers(0, 4, 300).astype(float)
    size = 2048
    who = M.signatures(np.concatenate([names[x > 0], names[y > 0]]), np.concatenate([x[x > 0], y[y > 0]]), np.array([0, (x > 0).sum(), (x > 0).sum() + (y > 0).sum()]), size)
    both = (x > 0) & (y > 0)
    true = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero(both))
    assert abs((who[0] == who[1]).mean() - true) < 0.04


def test_few_elements_fill_all_registers():
    who = M.signatures(np.array([7], np.uint64), np.array([1.0]), np.array([0, 1, 1]))
    assert (who[0] == 7).all() and (who[1] == 0).all()


def test_components(spark):
    path = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 205)]
    links = spark.createDataFrame(path, "a bigint, b bigint")
    got = {r["uid"]: r["class"] for r in M.components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in (100, 101, 102)}, 200: 200, 205: 200}


def test_repeated_shingles(spark):
    """Weights decide: repeating a part changes a text, repeating the whole does not."""
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(7)) for _ in range(n))
    rows = []
    for _ in range(4):
        a, b, c = line(50), line(20), line(60)
        rows += [(len(rows) + i, t) for i, t in enumerate((f"{a} {b}", f"{a}{(' ' + b) * 50}", c, f"{c} {c}", f"{a}{(' ' + b) * 48} {line(3)}"))]
    want = plain(rows)
    assert [want[i] for i in range(5)] == [0, 1, 2, 2, 1]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["id"]: r["class_id"] for r in M.classes(docs, "doc_id", "text").collect()} == want


def test_exact_probability_jaccard():
    rng = random.Random(4)
    for _ in range(300):
        x, y = ([rng.randrange(1, 12) for _ in range(rng.randint(1, 30))] for _ in range(2))
        got = M.probability_jaccard(np.sort(np.array(x, np.uint32)), np.sort(np.array(y, np.uint32)))
        assert abs(got - probability_jaccard(Counter(x), Counter(y))) < 1e-12
        sets = [np.unique(np.array(v, np.uint32)) for v in (x, y)]
        for least in (0.3, 0.5, 0.8):
            common, union = len(set(x) & set(y)), len(set(x) | set(y))
            assert M._alike(*sets, least) == (common >= least * union - 1e-9)


def test_floor_misses_less_than_the_bands():
    from math import comb

    floor = int(np.floor((0.8 - M.SLACK) * M.SIZE))
    below = sum(comb(M.SIZE, k) * 0.8**k * 0.2 ** (M.SIZE - k) for k in range(floor))
    assert below < 1e-6 and (1 - 0.8**M.ROWS) ** M.BANDS + below < 3.3e-6
