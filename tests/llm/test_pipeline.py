import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
import test_line_runs  # noqa: E402
import test_prob_minhash  # noqa: E402
from risewatch.llm import toxicity  # noqa: E402
from risewatch.llm.common import stored  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("driver tables are not here")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        out.append((name, docs))
    return dict(out)


def test_columns(stages):
    for name in ("toxicity", "line_dedup", "near_dedup", "decontamination"):
        assert stages[name].columns == stages["documents"].columns and stages[name].schema == stages["documents"].schema


def test_toxic_ones_go(spark, stages):
    docs = stages["documents"]
    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {r["doc_id"] for r in toxicity.score(docs, "text", model).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in stages["toxicity"].collect()} == want


def test_lines(stages):
    before = [(r["doc_id"], r["text"]) for r in stages["toxicity"].collect()]
    want = test_line_runs.plain(before)
    after = stages["line_dedup"].collect()
    assert {r["doc_id"]: r["text"] for r in after} == {k: v[0] for k, v in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_one_of_near_copies(stages):
    before = [(r["doc_id"], r["text"]) for r in stages["line_dedup"].collect()]
    want = test_prob_minhash.plain(before)
    assert {r["doc_id"] for r in stages["near_dedup"].collect()} == {k for k, v in want.items() if k == v}


def test_benchmark_passages_go(spark, stages):
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before, after = ({r["doc_id"]: r["text"] for r in stages[n].collect()} for n in ("near_dedup", "decontamination"))
    flat = lambda t: " ".join(t.split())
    leaks = {k for k, t in before.items() if any(flat(i) in flat(t) for i in items)}
    assert leaks and not leaks & set(after) and len(after) >= len(before) - 3 * len(leaks)


def test_round_trip(stages):
    rows = stages["byte_bpe"].collect()
    assert len(rows) == stages["decontamination"].count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_run(spark, stages):
    assert sorted(corpus_pipeline.run(spark, FOLDER).collect()) == sorted(stages["byte_bpe"].collect())
