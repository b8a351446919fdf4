"""A quick slice of the registered queries against their SQL; ``tests/oracle_check.py`` runs them all."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_check import compare, connect  # noqa: E402
from risewatch.catalog import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SLICE = [
    "agg_01_work_concept_bin_counts", "agg_02_dense_grid", "agg_13_collection_report", "rnk_03_share_momentum_topk",
    "win_21_kleinberg_bursts", "win_24_stage_curves", "prj_01_work_triples", "aln_06_audit", "grf_01_cooccurrence_facts_hubs",
    "grf_15_filtered_rank", "bt_02_link_backtest", "act_01_activity_chain", "str_03_daily_counts", "src_11_citation_table",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("driver tables are not here")
    return connect(FOLDER)


@pytest.mark.parametrize("name", SLICE)
def test_query_equals_sql(spark, con, name):
    text, ok = compare(spark, con, name, QUERIES, ORACLES, FOLDER)
    assert ok, text


def test_keys():
    assert set(ORACLES) <= set(QUERIES)
