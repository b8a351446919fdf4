"""Incremental runs: the id store, the manifest of idle and failed runs, online tags with late rows and timers."""

import json

import numpy as np
import pytest

from risewatch.operators.activity import API_FAILURE
from risewatch.streaming import incremental as I
from risewatch.streaming import runs, store, tags


def test_filters_hold_what_was_put_in():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    bits = store.bloom(keys[:4000])
    assert store.may_hold(bits, keys[:4000]).all()
    assert store.may_hold(bits, keys[4000:]).mean() < 0.03
    assert not store.may_hold(store.bloom(np.zeros(0, np.int64)), keys).any()


def test_reads_follow_the_batch_and_ids_stay_unique(spark, tmp_path):
    ids = store.IdStore(spark, str(tmp_path / "s"), buckets=16)
    schema = "id string, seq bigint"
    for batch in range(4):
        rows = [(f"b{batch}-{i}", i) for i in range(60)] + [("shared", 100 + batch), (None, 5), ("shared", 99)]
        ids.append(spark.createDataFrame(rows, schema), batch, "seq")
    ids.append(spark.createDataFrame([("late", 1), ("b0-3", 9)], schema), 4, "seq")
    ids.append(spark.createDataFrame([("late", 1), ("b0-3", 9)], schema), 4, "seq")  # the same batch again
    got = sorted((r.id, r.seq, r.batch) for r in ids.rows(schema + ", batch bigint").collect())
    assert got == sorted([(f"b{b}-{i}", i, b) for b in range(4) for i in range(60)] + [("shared", 99, 0), ("late", 1, 4)])
    few = ids.keyed(spark.createDataFrame([("b2-7", 1), ("fresh", 2)], schema))
    folders = ids.segments(few, 9)
    assert any("batch=2" in f for f in folders) and len(folders) <= 2  # of about 64 segments
    assert ids.segments(few.where("false"), 9) == []


def feed(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_idle_and_failed_runs_have_a_row(spark, tmp_path):
    src, path = tmp_path / "in", str(tmp_path / "runs")
    schema = "source string, error string, x int"
    write = lambda batch, batch_id: batch.write.mode("overwrite").parquet(str(tmp_path / "rows" / f"batch={batch_id}"))
    run = lambda w=write: runs.run_once(I.ingest_stream(spark, str(src), schema), path, w)
    feed(src, "a.json", [{"source": "arxiv", "x": 1}, {"source": "arxiv", "x": 2}, {"source": "gdelt", "x": 3}])
    run()
    run()
    feed(src, "b.json", [{"source": "gdelt", "x": 4}, {"source": "gdelt", "error": "boom"}])
    run()
    feed(src, "c.json", [{"source": "arxiv", "x": 5}])

    def broken(batch, batch_id):
        raise ValueError("disk full")

    with pytest.raises(Exception, match="disk full"):
        run(broken)
    run()
    run()
    rows = [(r.run_id, r.status, r.noop, r.new_records) for r in runs.read_manifest(spark, path).orderBy("run_id").collect()]
    assert rows == [
        (0, "ok", False, {"arxiv": 2, "gdelt": 1}), (1, "ok", True, {}), (2, "error", False, {"gdelt": 1}),
        (3, "error", False, {}), (4, "ok", False, {"arxiv": 1}), (5, "ok", True, {}),
    ]
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 5
    counts, per = I.weekly_rollup(runs.read_manifest(spark, path), "2000-01-01")
    assert tuple(counts.first()) == (2, 2, 2) and {r.source: r.new_records for r in per.collect()} == {"arxiv": 3, "gdelt": 2}


def test_late_rows_and_silent_series_go_aside(spark, tmp_path):
    src, found, side, log = tmp_path / "in", *(str(tmp_path / n) for n in ("tags", "side", "log"))
    row = lambda day, value, topic="a": {"topic_id": topic, "source": "s", "window_start": f"2026-01-{day:02d}", "value": value}
    run = lambda **limits: tags.run_tags(I.ingest_stream(spark, str(src), "topic_id string, source string, window_start string, value double"), found, side, log, **limits)
    feed(src, "1.json", [row(1, 0.0), row(2, 0.0), row(1, 0.0, "b"), row(2, 0.0, "b")])
    run(quiet_ms=1)
    feed(src, "2.json", [row(3, 0.0), row(1, 5.0), row(4, None)])
    run(quiet_ms=1)
    got = {(r.topic_id, r.window_start, r.tag) for r in tags.read_tags(spark, found).collect()}
    aside = {(r.topic_id, r.window_start, r.tag) for r in tags.read_tags(spark, side).collect()}
    # the run of zeros of `a` goes on from the first run; the timer of `b` ended its series
    assert got == {("a", f"2026-01-0{d}", API_FAILURE) for d in (1, 2, 3)}
    assert ("a", "2026-01-01", tags.LATE) in aside and ("b", "2026-01-02", tags.SILENT) in aside
