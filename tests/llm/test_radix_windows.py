import random

import numpy as np
import pytest

from risewatch.llm import radix_windows as R


def plain(rows):
    seen, out = set(), {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        starts = [i for i in range(len(b) - 49) if b[i : i + 50] in seen]
        gone = set().union(*(range(i, i + 50) for i in starts)) if starts else set()
        seen |= {b[i : i + 50] for i in range(len(b) - 49)}
        out[k] = (len(b), len(gone), sum(i - 1 not in gone for i in gone), bytes(x for i, x in enumerate(b) if i not in gone))
    return out


def documents(seed, alphabet):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    pieces = [word(n) for n in (30, 49, 50, 51, 60, 70, 90, 140, 400)]
    rows = [(i, "".join(rng.choice(pieces) if rng.random() < 0.5 else word(rng.randint(1, 60)) for _ in range(rng.randint(1, 12)))) for i in range(80)]
    rows += [(80 + i, rows[i % 7][1]) for i in range(20)] + [(200, None), (201, ""), (202, "a" * 700), (203, "a" * 49), (204, "b" + "a" * 60), (205, "ab" * 300), (206, "ba" * 60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij ", "éa日\n"])
def test_like_the_plain_version(spark, alphabet):
    for seed in (1, 2):
        rows = documents(seed, alphabet)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in R.remove_repeats(docs, "doc_id", "text").collect()}
        assert got == plain(rows)


def test_every_window_holds_an_anchor():
    rng = np.random.default_rng(2)
    for data in (rng.integers(97, 99, 5000), rng.integers(0, 256, 5000), np.full(500, 97)):
        data = data.astype(np.uint8)
        at, _ = R.anchors(data, np.array([0, len(data)]))
        edges = np.concatenate([[-1], at, [len(data) - R.GRAM + 1]])
        assert np.diff(edges).max() <= R.AROUND + 1


def test_anchors_do_not_depend_on_what_is_around(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 101, 4000).astype(np.uint8)
    whole = R.anchors(data, np.array([0, 4000]))[0]
    part = R.anchors(data[1000:1400], np.array([0, 400]))[0] + 1000
    assert part.tolist() == [i for i in whole.tolist() if 1000 <= i <= 1400 - R.GRAM]
    monkeypatch.setattr(R, "STEP", 100)
    assert R.anchors(data, np.array([0, 4000]))[0].tolist() == whole.tolist()


def test_packing():
    values = np.array([0, 1, 2**40 - 1, 2**39 + 5], np.uint64)
    assert (R._unpack40(R._pack40(values)) == values).all()


def test_equal_ids_are_not_smaller(spark):
    text = "".join(random.Random(9).choice("abcdef") for _ in range(200))
    docs = spark.createDataFrame([(1, text), (1, text + "x"), (2, "y" + text), (None, text), (None, text[:120])], "doc_id bigint, text string")
    got = sorted((str(r["id"]), r["n_removed"]) for r in R.remove_repeats(docs, "doc_id", "text").collect())
    assert got == [("1", 0), ("1", 0), ("2", 200), ("None", 120), ("None", 200)]
