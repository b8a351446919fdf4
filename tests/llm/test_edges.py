"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import os
import sys

import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_fixtures import SCHEMA, awkward  # noqa: E402

from risewatch.llm import bottom_k, byte_bpe, license_scan, line_runs, prob_minhash, radix_windows, skip_chain, spaced_seeds, tag_paths, toxicity  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def bench(spark):
    return spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (2, None), (3, ""), (None, "x y z u v w"), (4, "one two")], "item_id bigint, text string")


def labels(spark):
    return spark.createDataFrame([(5, 1, 1), (9, 1, 0), (None, 0, 1), (10, 1, None)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "skip_chain": lambda s, d: skip_chain.detect(d, "text", skip_chain.Field(skip_chain.train(d, "text"))),
    "toxicity": lambda s, d: toxicity.score(d, "text", toxicity.fit(d, labels(s))),
    "line_runs": lambda s, d: line_runs.dedup_lines(d, "doc_id", "text"),
    "byte_bpe": lambda s, d: byte_bpe.decode(byte_bpe.encode(d, "text", PATH, public_tokenizers.PATTERN).withColumnRenamed("ids_", "tokens"), "tokens", PATH),
    "license_scan": lambda s, d: license_scan.scan_licenses(d, "text"),
    "bottom_k": lambda s, d: bottom_k.fingerprint(d, "text"),
    "edited_pairs": lambda s, d: bottom_k.edited_pairs(d, "doc_id", "text"),
    "spaced_seeds": lambda s, d: spaced_seeds.mark(d, "text", bench(s), "item_id", "text"),
    "radix_windows": lambda s, d: radix_windows.remove_repeats(d, "doc_id", "text"),
    "prob_minhash": lambda s, d: prob_minhash.classes(d, "doc_id", "text"),
    "tag_paths": lambda s, d: tag_paths.extract_pages(d, "text"),
}
KEEPS_COLUMNS = {"skip_chain", "toxicity", "line_runs", "license_scan", "bottom_k", "spaced_seeds", "tag_paths"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = OPERATORS[name](spark, docs)
    found = out.collect()
    assert len(found) == len(rows)
    if name in KEEPS_COLUMNS:
        assert out.columns[: len(docs.columns)] == docs.columns
        assert all(r["spans"] == "clash" and r["gone"] == "clash" for r in found)
    assert len({c.lower() for c in out.columns}) == len(out.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_rows_get_equal_results(spark):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    for name in ("radix_windows", "prob_minhash", "line_runs", "edited_pairs"):
        out = OPERATORS[name](spark, docs)
        key = "doc_id" if "doc_id" in out.columns else "id"
        if name == "edited_pairs":  # the second row of a pair is followed by another text
            continue
        same = [tuple(r) for r in out.where(F.col(key) == 9).collect()]
        assert len(same) == 3 and len(set(same)) == 2, name
