"""The conversation trie against a plain one built from dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from risewatch.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, depth string, d1 string, slice string"


def rows_of(turns):
    return [(*t, "clash", "clash", "clash", "clash") for t in turns]


def in_order(turns):
    told = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            told[conv].append(((turn is not None, turn or 0, key), (role, text)))
    return {c: [t for _, t in sorted(v)] for c, v in told.items()}


def reborn(told):
    out = {}
    for c, turns in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = told.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def plain(sequences):
    """(conv, depth, parent, n_convs, n_children, n_leaves, saved, ends) of every node."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)

    def below(path):
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        found = [below(k) for k in kids[path]]
        return own + sum(s for s, _ in found), sum(n for _, n in found) or 1

    out = set()
    for path, convs in members.items():
        saved, leaves = below(path)
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.add((min(convs), len(path), parent, len(convs), len(kids[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def chats(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        c = rng.choice([0, 100, 200, -100]) + rng.randrange(0, 40)
        for t in range(rng.randrange(0, 7)):
            out.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "ä日"])))
    return out


def found(df):
    return {tuple(r) for r in df.select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256").collect()}


def rebuilt(spark, turns):
    df = spark.createDataFrame(rows_of(turns), SCHEMA)
    return pt.trie(pt.rebuild(pt.in_order(pt.hashed_turns(df))))


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_conversations(spark, seed):
    turns = chats(seed)
    df = rebuilt(spark, turns)
    want = plain(reborn(in_order(turns)))
    assert found(df) == want and df.count() == len(want)


def test_conversations_as_they_are(spark):
    turns = chats(3)
    assert found(pt.conversation_trie(spark.createDataFrame(rows_of(turns), SCHEMA))) == plain(in_order(turns))


def test_a_saturated_sketch_changes_nothing(spark, monkeypatch):
    turns = chats(4)
    monkeypatch.setattr(pt, "width", lambda n: 1 << 16)
    spy = []
    whole = pt.screen
    monkeypatch.setattr(pt, "screen", lambda rows, sketch: spy.append(1) or whole(rows, np.where(np.arange(sketch.size).reshape(sketch.shape) % 3 == 0, pt.FULL, sketch)))
    assert found(rebuilt(spark, turns)) == plain(reborn(in_order(turns))) and spy


def test_noisy_sketch_changes_nothing(spark, monkeypatch):
    """Estimates above one at random depths: a proven singleton may have grouped descendants and ancestors."""
    turns = chats(5, 90)
    monkeypatch.setattr(pt, "count_min", lambda rows, a, b, cells, f=pt.count_min: np.maximum(f(rows, a, b, cells), np.random.default_rng(1).integers(0, 3, (2, cells)).astype(np.uint8)))
    assert found(rebuilt(spark, turns)) == plain(reborn(in_order(turns)))


def test_sketch_never_underestimates(spark):
    rows = spark.range(3000).select((F.xxhash64(F.col("id") % 700)).alias("a"), F.xxhash64(F.lit(2), F.col("id") % 700).alias("b"))
    sketch = pt.count_min(rows.repartition(5), "a", "b", 1 << 16)
    mask = sketch.shape[1] - 1
    for a, b, n in rows.groupBy("a", "b").count().collect():
        assert min(sketch[0, a & mask], sketch[1, b & mask]) >= min(n, pt.FULL)
    assert int(sketch[0].sum()) == 3000


def test_one_long_conversation_over_slices(spark):
    """A conversation with most of the rows is cut by slices; two copies of it share all but the last turn."""
    turns = [(c, t, "user", f"t{t}" if t < 1999 else f"end {c}") for c in (0, 1) for t in range(2000)] + [(7, 0, "user", "x")]
    nodes = pt.conversation_trie(spark.createDataFrame(rows_of(turns), SCHEMA))
    told = in_order(turns)
    got = {(r["conv"], r["depth"]): r for r in nodes.collect()}
    assert len(got) == 2000 + 2 + 1
    assert got[0, 0]["n_convs"] == 3 and got[0, 0]["n_leaves"] == 3 and got[0, 0]["saved"] == sum(len(x) for _, x in told[0][:1999])
    assert all(got[0, d]["n_convs"] == 2 and got[0, d]["n_leaves"] == 2 and got[0, d]["n_children"] == (2 if d == 1999 else 1) for d in range(1, 2000))
    assert got[1, 2000]["parent"] == 0 and got[0, 2000]["n_convs"] == 1 and got[7, 1]["parent"] == 0


def test_many_copies_and_a_hot_first_turn(spark, monkeypatch):
    monkeypatch.setattr(pt, "HEAVY", 3)
    turns = [(c, t, "user", "same") for c in range(150) for t in range(2)] + [(c, t, "user", "same" if t == 0 else f"{c}") for c in range(150, 400) for t in range(2)]
    assert found(pt.conversation_trie(spark.createDataFrame(rows_of(turns), SCHEMA))) == plain(in_order(turns))


def test_single_and_empty(spark):
    one = [(5, 0, "user", "x"), (5, 1, None, None)]
    assert found(pt.conversation_trie(spark.createDataFrame(rows_of(one), SCHEMA))) == plain(in_order(one))
    for turns in ([], [(None, 1, "user", "x")]):
        assert rebuilt(spark, turns).collect() == []


def test_text_ids(spark):
    df = spark.createDataFrame([("b", 0, "user", "x"), ("a", 0, "user", "x")], "conv_id string, turn bigint, role string, text string")
    top = {r["depth"]: r for r in pt.conversation_trie(df).collect()}
    assert top[1]["conv"] == "a" and top[1]["ends_sha256"] == hashlib.sha256(b"a,b").hexdigest()
