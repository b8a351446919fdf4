"""Timed headline queries; prints one JSON line.

Every query runs once untimed on the smallest tables (class loading, code generation) and once timed on
``$BENCH_SF_DIR``. Results are written to the ``noop`` sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from risewatch.catalog import QUERIES
from risewatch.session import local_session

HEADLINE = [
    "agg_01_concept_bin_counts",
    "rnk_03_share_momentum_topk",
    "rnk_04_burst_topk",
    "win_23_concept_stages",
    "agg_10_cumulative_citations",
    "prj_01_work_triples",
    "agg_05_merge_nodes",
    "aln_04_fuzzy_names",
    "grf_01_cooccurrence_facts",
    "grf_10_transitivity_rules",
    "grf_15_filtered_rank",
    "bt_01_ranking_backtest",
    "bt_02_link_backtest",
    "act_01_activity_chain",
    "scl_02_normalize_name",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    run = lambda name, d: QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if os.path.isdir(warm):
            run(name, warm)
        start = time.perf_counter()
        run(name, folder)
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
