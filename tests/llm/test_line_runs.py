import itertools
import random

from pyspark.sql import functions as F

from risewatch.llm import line_runs as L


def plain(rows, min_chars=40):
    seen, out = set(), {}
    for k, t in sorted(rows):
        lines = t.split("\n")
        busy = [i for i, x in enumerate(lines) if x.strip(" ")]
        keys = [lines[i].strip(" ") for i in busy]
        gone = set()
        for i in range(len(keys)):
            if (keys[i],) in seen and len(keys[i]) >= min_chars:
                gone.add(busy[i])
            seen.add((keys[i],))
            if i + 1 < len(keys):
                if (keys[i], keys[i + 1]) in seen:
                    gone |= {busy[i], busy[i + 1]}
                seen.add((keys[i], keys[i + 1]))
        out[k] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def documents(seed, n=60, words=8):
    rng = random.Random(seed)
    pool = [f"line {i} " + "x" * rng.choice([0, 1, 60]) for i in range(words)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(n)]
    long = "\n".join(f"unique {i}" for i in range(40))
    return rows + [(n + i, long + f"\ntail {i}") for i in range(9)]


def test_like_the_plain_version(spark):
    for seed in (1, 2):
        rows = documents(seed, words=8 * seed)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in L.dedup_lines(docs, "doc_id", "text").collect()}
        assert got == plain(rows)


def test_ranks_order_the_suffixes(spark):
    rows = [(0, "a\nb\na\nb\nc"), (1, "b\na\nb\nc"), (2, "c\nc\nc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = L.suffix_ranks(docs, "doc_id", "text").collect()
    lines = {r[0]: r[1].split("\n") for r in rows}
    rank0 = {}
    suffix = {(r["id"], r["seq"]): tuple(lines[r["id"]][r["seq"] :]) for r in found}
    order = {(r["id"], r["seq"]): r["rank"] for r in found}
    for x, y in itertools.combinations(order, 2):
        assert (order[x] == order[y]) == (suffix[x] == suffix[y])
    for k in order:
        rank0.setdefault(suffix[k][0], set()).add(order[k])
    # suffixes of one first line are neighbours
    spans = sorted((min(v), max(v)) for v in rank0.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_a_run_is_one_maximal_run(spark):
    run = "\n".join(f"shared line {i}" for i in range(11))
    docs = spark.createDataFrame([(1, "first\n" + run), (2, run + "\nlast"), (3, "own\n" + run)], "doc_id bigint, text string")
    runs = L.later_runs(docs, "doc_id", "text").groupBy("id", "run").agg(F.count("*").alias("n")).collect()
    assert sorted((r["id"], r["n"]) for r in runs) == [(2, 11), (3, 11)]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "a\nb")], "doc_id bigint, text string")
    plan = L.dedup_lines(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
