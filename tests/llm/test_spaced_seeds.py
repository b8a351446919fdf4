import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_fixtures import prose  # noqa: E402

from risewatch.llm import spaced_seeds as S  # noqa: E402


def run(spark, texts, items, **settings):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return {r["doc_id"]: {o["item_id"]: (o["n_matched"], o["first_word"], o["n_words"]) for o in r["overlaps"]} for r in S.mark(docs, "text", bench, "item_id", "text", **settings).collect()}


def brute(texts, items, least=12, share=0.8, shortest=5):
    out = {}
    for d, t in enumerate(texts):
        w, found = S.words(t or ""), {}
        for k, x in items:
            v = S.words(x)
            if len(v) < shortest:
                continue
            for start in range(-len(v) + 1, len(w)):
                same = np.array([w[start + j] == v[j] for j in range(max(0, -start), min(len(v), len(w) - start))])
                if same.sum() >= min(least, -(-share * len(v) // 1)):
                    found[k] = max(found.get(k, 0), S.best_run(same)[2])
        out[d] = {k: n for k, n in found.items() if n >= min(least, int(np.ceil(share * len(S.words(dict(items)[k])))))}
    return out


def test_substitutions_and_clean_texts(spark):
    rng = random.Random(3)
    items = [(i, prose(100 + i, rng.randint(14, 50))) for i in range(12)] + [(50, prose(150, 7)), (51, "the of"), (52, "")]
    texts = []
    for i in range(12):
        own = S.words(dict(items)[i])
        for at in range(3, len(own), 6):  # every sixth word replaced
            own[at] = "other"
        texts.append(prose(i, 80) + " " + " ".join(own).upper() + ". " + prose(200 + i, 50))
    texts += [prose(500 + i, 300) for i in range(10)] + [prose(1, 20) + " " + dict(items)[50], dict(items)[3], None, ""]
    got = run(spark, texts, items)
    want = brute(texts, items)
    assert {d: {k: n for k, (n, _, _) in v.items()} for d, v in got.items()} == want
    assert all(i in want[i] for i in range(12)) and all(want[i] == {} for i in range(12, 22)) and 50 in want[22] and 3 in want[23]


def test_blocks_give_the_same(spark):
    items = [(i, prose(100 + i, 20)) for i in range(30)]
    texts = [prose(1, 40) + " " + items[i % 30][1] + " " + items[(7 * i) % 30][1] for i in range(40)]
    assert run(spark, texts, items, block=200) == run(spark, texts, items)


def test_empty_benchmark(spark):
    assert run(spark, ["a b c d e f g h i j k l m n"], []) == {0: {}}


def test_best_run_is_the_earliest_best():
    assert S.best_run(np.array([1, 1, 0, 1, 1, 1, 1, 0, 0, 1, 1], bool)) == (3, 7, 4)
    assert S.best_run(np.zeros(3, bool)) == (0, 0, 0)


def missed_runs(masks, need, longest):
    """Shortest runs of ``need`` matches that no mask meets: every prefix scores above zero, the end is a new best score."""
    span, found, seen, todo = max(map(len, masks)), [], set(), [("", 0, 0, 0)]
    while todo:
        run, score, best, matched = todo.pop()
        for bit in "10" if longest is None or len(run) < longest else "":
            now, s, m = run + bit, score + (1 if bit == "1" else -2), min(need, matched + (bit == "1"))
            if s <= 0 or any(len(k) <= len(now) and all(a <= b for a, b in zip(k, now[-len(k) :])) for k in masks):
                continue
            if s > best and m >= need:
                found.append(now)
                continue
            state = (now[-span:], s, max(best, s), m, longest and len(now))
            if state not in seen:
                seen.add(state)
                todo.append((now, s, max(best, s), m))
    return found


def test_every_admissible_run_meets_a_mask():
    assert missed_runs(("1101100111", "1011010111", "1110101101", "1101011011"), 12, None)
    for n in range(5, 16):
        need = min(12, int(np.ceil(0.8 * n)))
        assert missed_runs(S.masks_of(n), need, n if n < 15 else None) == [], n


def test_replaced_words_of_whole_items():
    """Whole-item copies with each set of up to two replaced words (four in some longer items)."""
    from itertools import combinations

    rng = random.Random(4)
    for n in (5, 6, 7, 8, 9, 10, 11, 13, 16, 18, 20):
        known = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        probe = S.Probe([(1, known.tobytes())])
        holes = [c for k in range(5 if n in (16, 18) else 3) for c in combinations(range(n), k)]
        texts = np.tile(known, (len(holes), 1))
        for row, c in zip(texts, holes):
            row[list(c)] = np.array([rng.getrandbits(64) for _ in c], np.uint64)
        got = probe.overlaps(texts.ravel(), np.arange(len(holes) + 1) * n, 12, 0.8)
        want = [S.best_run(row == known)[2] >= min(12, int(np.ceil(0.8 * n))) for row in texts]
        assert [bool(g) for g in got] == want, n
        assert sum(want) > 1
