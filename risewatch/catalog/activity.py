"""Queries over activity records."""

from __future__ import annotations

from pyspark.sql import functions as F

from risewatch import bindings as B
from risewatch.catalog.registry import query
from risewatch.catalog.series import r6
from risewatch.operators import activity as A
from risewatch.plans.activity_chain import activity_chain
from risewatch.sources.repos import repo_topic_rollup, snapshot_delta
from risewatch.session import durable

SRC = A.SOURCES

RECORDS = """rec AS (
  SELECT source, topic_id, upper(topic_id) AS topic_label, window_start, window_start AS window_end, collection_status,
    CASE WHEN collection_status = 'ok' THEN n END AS activity_count, CASE WHEN collection_status = 'failed' THEN 'error ' || (n % 3) END AS error
  FROM (SELECT source, topic_id, window_start, collection_status, count(*) AS n FROM (
      SELECT event_type AS topic_id, strftime(ts, '%Y-%m-%d') AS window_start,
        CASE user_id % 6 WHEN 0 THEN 'openalex' WHEN 1 THEN 'crossref' WHEN 2 THEN 'arxiv' WHEN 3 THEN 'uspto' WHEN 4 THEN 'gdelt' ELSE 'github' END AS source,
        CASE WHEN regexp_replace(props, '[^0-9]', '', 'g')::INT % 17 = 0 THEN 'failed' ELSE 'ok' END AS collection_status FROM events)
    GROUP BY 1, 2, 3, 4))"""
PIVOT = RECORDS + ", piv AS (SELECT topic_id, topic_label, window_start, window_end, " + ", ".join(
    f"coalesce(sum(activity_count) FILTER (WHERE source = '{s}'), 0)::DOUBLE AS {s}_count" for s in SRC
) + " FROM rec WHERE collection_status = 'ok' AND activity_count IS NOT NULL GROUP BY 1, 2, 3, 4)"
# Counts of 0 are rare in the events, so the tag checks read a thinned pivot: cells below 9 become 0.
THIN = PIVOT + ", thin AS (SELECT topic_id, topic_label, window_start, window_end, " + ", ".join(
    f"CASE WHEN {s}_count < 9 THEN 0 ELSE {s}_count END AS {s}_count" for s in SRC
) + " FROM piv)"


def _long(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT topic_id, window_start, '{s}_count' AS source, {s}_count AS value FROM {table}" for s in SRC
    )


LONG = THIN + f", long AS ({_long('thin')})"
TAGS = LONG + """, seq AS (SELECT *, row_number() OVER (PARTITION BY topic_id, source ORDER BY window_start) AS i, ln(1 + value) AS lv FROM long),
zs AS (SELECT s.topic_id, s.source, s.i, count(p.lv) >= 2 AND stddev_pop(p.lv) >= 1e-9 AND abs(s.lv - avg(p.lv)) / stddev_pop(p.lv) > 3 AS z
  FROM seq s LEFT JOIN seq p ON p.topic_id = s.topic_id AND p.source = s.source AND p.i BETWEEN s.i - 6 AND s.i - 1 GROUP BY s.topic_id, s.source, s.i, s.lv),
past AS (SELECT s.topic_id, s.source, s.i, s.value, list_sort(list(p.value) FILTER (WHERE p.value IS NOT NULL)) AS v
  FROM seq s LEFT JOIN seq p ON p.topic_id = s.topic_id AND p.source = s.source AND p.i BETWEEN s.i - 6 AND s.i - 1 GROUP BY s.topic_id, s.source, s.i, s.value),
iq AS (SELECT topic_id, source, i, coalesce(len(v) >= 4 AND q3 - q1 >= 1e-9 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)), false) AS q
  FROM (SELECT *, v[len(v) // 4 + 1] AS q1, v[(3 * len(v)) // 4 + 1] AS q3 FROM past)),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY topic_id, source, value = 0 ORDER BY i) AS g FROM seq),
zr AS (SELECT topic_id, source, i, value = 0 AND count(*) OVER (PARTITION BY topic_id, source, value = 0, g) >= 3 AS zero_run FROM isl),
dr AS (SELECT topic_id, source, i, value <= 0 AND coalesce(lag(run) OVER (PARTITION BY topic_id, source ORDER BY i), 0) >= 3 AS sdrop
  FROM (SELECT *, CASE WHEN value > 0 THEN row_number() OVER (PARTITION BY topic_id, source, value > 0, h ORDER BY i) ELSE 0 END AS run
        FROM (SELECT *, i - row_number() OVER (PARTITION BY topic_id, source, value > 0 ORDER BY i) AS h FROM seq))),
tags AS (SELECT s.topic_id, s.window_start, s.source, s.value, coalesce(zs.z, false) AS zscore_outlier, iq.q AS iqr_outlier,
    CASE WHEN zr.zero_run THEN 'likely_api_failure' WHEN dr.sdrop THEN 'sudden_drop' ELSE '' END AS zero_tag, zr.zero_run, dr.sdrop
  FROM seq s JOIN zs USING (topic_id, source, i) JOIN iq USING (topic_id, source, i) JOIN zr USING (topic_id, source, i) JOIN dr USING (topic_id, source, i))"""


def pivot(spark, d):
    ok, _ = A.split_failed(B.records(spark, d))
    return A.activity_pivot(ok)


def thin(spark, d):
    p = pivot(spark, d)
    return p.select(
        *[F.when(F.col(c) < 9, 0.0).otherwise(F.col(c)).alias(c) if c.endswith("_count") else F.col(c) for c in p.columns]
    )


def thin_long(spark, d):
    p = thin(spark, d)
    return A.melt(p, A.count_columns(p))


COLS = "source, topic_id, topic_label, window_start, activity_count"


@query("flt_01_ok_records", f"WITH {RECORDS} SELECT {COLS} FROM rec WHERE collection_status = 'ok' AND activity_count IS NOT NULL")
def _(spark, d):
    return A.split_failed(B.records(spark, d))[0].select(*COLS.split(", "))


@query("flt_01_failed_records", f"WITH {RECORDS} SELECT {COLS} FROM rec WHERE collection_status <> 'ok' OR activity_count IS NULL")
def _(spark, d):
    return A.split_failed(B.records(spark, d))[1].select(*COLS.split(", "))


@query("set_01_merge_sources", f"WITH {RECORDS} SELECT {COLS} FROM rec WHERE source IN ('openalex', 'github', 'gdelt')")
def _(spark, d):
    r = B.records(spark, d)
    parts = [r.where(F.col("source") == s) for s in ("openalex", "github")]
    return A.merge_sources(*parts, r.where("source = 'gdelt'").drop("error")).select(*COLS.split(", "))


@query("agg_11_activity_pivot", f"WITH {PIVOT} SELECT * FROM piv")
def _(spark, d):
    return pivot(spark, d)


@query(
    "agg_12_cleaning_log",
    f"""WITH {RECORDS} SELECT source, count(*) AS input_count, count(*) FILTER (WHERE collection_status = 'ok') AS ok_count,
    count(*) FILTER (WHERE collection_status <> 'ok') AS failed_count FROM rec GROUP BY ROLLUP (source)""",
)
def _(spark, d):
    return A.cleaning_log(B.records(spark, d))


@query(
    "agg_13_collection_report",
    f"""WITH {RECORDS} SELECT topic_id, source, topic_label, count(*) FILTER (WHERE collection_status = 'ok') AS ok,
      count(*) FILTER (WHERE collection_status <> 'ok') AS failed FROM rec GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return A.collection_report(B.records(spark, d))


@query(
    "agg_13_collection_errors",
    f"WITH {RECORDS} SELECT topic_id, source, error, count(*) AS times FROM rec WHERE error IS NOT NULL GROUP BY 1, 2, 3",
)
def _(spark, d):
    return A.collection_errors(B.records(spark, d))


@query("agg_16_feature_matrix", f"WITH {RECORDS} SELECT topic_id, window_start, source, activity_count FROM rec")
def _(spark, d):
    return A.feature_matrix(B.records(spark, d)).select("topic_id", "window_start", "source", "activity_count")


@query("win_07_zscore_outlier", f"WITH {TAGS} SELECT topic_id, window_start, source, value, zscore_outlier FROM tags")
def _(spark, d):
    return A.zscore_outlier(thin_long(spark, d))


@query("win_08_iqr_outlier", f"WITH {TAGS} SELECT topic_id, window_start, source, value, iqr_outlier FROM tags")
def _(spark, d):
    return A.iqr_outlier(thin_long(spark, d))


@query(
    "win_09_zero_runs",
    f"WITH {TAGS} SELECT topic_id, window_start, source, value, CASE WHEN zero_run THEN 'likely_api_failure' ELSE '' END AS zero_run_tag FROM tags",
)
def _(spark, d):
    return A.zero_runs(thin_long(spark, d))


@query(
    "win_10_sudden_drop",
    f"WITH {TAGS} SELECT topic_id, window_start, source, value, CASE WHEN sdrop THEN 'sudden_drop' ELSE '' END AS drop_tag FROM tags",
)
def _(spark, d):
    return A.sudden_drop(thin_long(spark, d))


_T = {"zscore_outlier": "zscore_outlier", "iqr_outlier": "iqr_outlier", "zero_tag": "zero_tag", "any_anomaly": "zscore_outlier OR iqr_outlier OR zero_tag <> ''"}
TAGGED = TAGS + ", wide AS (SELECT topic_id, window_start, " + ", ".join(
    f"max(CASE WHEN source = '{s}_count' THEN {e} END) AS {s}_count_{t}" for s in SRC for t, e in _T.items()
) + " FROM tags GROUP BY 1, 2), tagged AS (SELECT t.*, w.* EXCLUDE (topic_id, window_start) FROM thin t JOIN wide w ON w.topic_id = t.topic_id AND w.window_start = t.window_start)"


@query("win_11_tag_anomalies", f"WITH {TAGGED} SELECT * FROM tagged")
def _(spark, d):
    return A.tag_anomalies(durable(thin(spark, d)))


@query(
    "agg_14_anomaly_summary",
    f"""WITH {TAGS}, c AS (SELECT topic_id, source, zscore_outlier OR iqr_outlier OR zero_tag <> '' AS hit FROM tags)
    SELECT 'source' AS level, source AS name, count(*) FILTER (WHERE hit) AS anomalies, count(*) AS total FROM c GROUP BY 2
    UNION ALL SELECT 'topic', topic_id, count(*) FILTER (WHERE hit), count(*) FROM c GROUP BY 2
    UNION ALL SELECT 'all', '', count(*) FILTER (WHERE hit), count(*) FROM c""",
)
def _(spark, d):
    return A.anomaly_summary(A.tag_anomalies(durable(thin(spark, d))))


_ANY = lambda t: "(" + " OR ".join(f"{s}_count_{t}" for s in SRC) + ")"
_ALL = lambda t: "(" + " AND ".join(f"{s}_count_zero_tag = '{t}'" for s in SRC) + ")"


@query(
    "flt_07_drop_anomalous",
    f"WITH {TAGGED} SELECT topic_id, window_start FROM tagged WHERE NOT ({_ANY('zscore_outlier')} OR {_ANY('iqr_outlier')} OR {_ALL('likely_api_failure')})",
)
def _(spark, d):
    tagged = durable(A.tag_anomalies(durable(thin(spark, d))))
    kept, _ = A.drop_anomalous(tagged, drop_zscore=True, drop_iqr=True)
    return kept.select("topic_id", "window_start")


@query(
    "flt_07_drop_counts",
    f"""WITH {TAGGED} SELECT count(*) FILTER (WHERE {_ANY('zscore_outlier')}) AS zscore, count(*) FILTER (WHERE {_ANY('iqr_outlier')}) AS iqr,
      count(*) FILTER (WHERE {_ALL('likely_api_failure')}) AS likely_api_failure, count(*) FILTER (WHERE {_ALL('sudden_drop')}) AS sudden_drop,
      count(*) FILTER (WHERE {_ANY('zscore_outlier')} OR {_ANY('iqr_outlier')} OR {_ALL('likely_api_failure')} OR {_ALL('sudden_drop')}) AS total_dropped FROM tagged""",
)
def _(spark, d):
    tagged = durable(A.tag_anomalies(durable(thin(spark, d))))
    return A.drop_anomalous(tagged, drop_zscore=True, drop_iqr=True, drop_sudden_drop=True)[1]


# Gap fill: every third day of each topic is removed first, and the catalogue runs past the data.
GAPS = PIVOT + """, gap AS (SELECT * FROM piv WHERE day(window_start::DATE) % 3 <> 0),
cal AS (SELECT strftime(d, '%Y-%m-%d') AS window_start FROM generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE + 5 FROM events), INTERVAL 1 DAY) g(d)),
grid AS (SELECT t.topic_id, t.topic_label, c.window_start FROM (SELECT DISTINCT topic_id, topic_label FROM gap) t CROSS JOIN cal c)"""
FILLED = GAPS + ", filled AS (SELECT g.topic_id, g.topic_label, g.window_start, last_value(p.window_end IGNORE NULLS) OVER w AS window_end, " + ", ".join(
    f"coalesce(last_value(p.{s}_count IGNORE NULLS) OVER w, 0) AS {s}_count" for s in SRC
) + """, p.openalex_count IS NULL AS _filled FROM grid g LEFT JOIN gap p ON p.topic_id = g.topic_id AND p.window_start = g.window_start
  WINDOW w AS (PARTITION BY g.topic_id ORDER BY g.window_start ROWS UNBOUNDED PRECEDING))"""


def gaps(spark, d):
    return pivot(spark, d).where(F.day(F.to_date("window_start")) % 3 != 0)


@query("win_12_fill_forward", f"WITH {FILLED} SELECT * FROM filled")
def _(spark, d):
    return A.fill_windows(durable(gaps(spark, d)), B.day_windows(spark, d), "forward_fill")


@query(
    "win_12_fill_zero",
    f"WITH {GAPS} SELECT g.topic_id, g.window_start, " + ", ".join(f"coalesce(p.{s}_count, 0) AS {s}_count" for s in SRC)
    + " FROM grid g LEFT JOIN gap p ON p.topic_id = g.topic_id AND p.window_start = g.window_start",
)
def _(spark, d):
    out = A.fill_windows(durable(gaps(spark, d)), B.day_windows(spark, d), "zero_fill")
    return out.select("topic_id", "window_start", *[f"{s}_count" for s in SRC])


@query(
    "win_13_smooth",
    f"WITH {PIVOT} SELECT topic_id, window_start, " + ", ".join(f"round(median({s}_count) OVER w, 2) AS {s}_count_smoothed" for s in SRC)
    + " FROM piv WINDOW w AS (PARTITION BY topic_id ORDER BY window_start ROWS 2 PRECEDING)",
)
def _(spark, d):
    return A.smooth(pivot(spark, d)).select("topic_id", "window_start", *[f"{s}_count_smoothed" for s in SRC])


def _std(table: str, expr: str, extra: str = "") -> str:
    return f"""SELECT topic_id, window_start, {', '.join(f"max(CASE WHEN source = '{s}_count' THEN std END) AS {s}_count_std" for s in SRC)}
    FROM (SELECT l.topic_id, l.window_start, l.source, {expr} AS std FROM {table} l {extra}) GROUP BY 1, 2"""


STD_LONG = PIVOT + f", lng AS ({_long('piv')})"
QSTATS = """, qs AS (SELECT window_start, source, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) AS q3,
    min(value) AS lo, max(value) AS hi, min(ln(1 + value)) AS llo, max(ln(1 + value)) AS lhi, count(*) AS n FROM lng GROUP BY 1, 2)"""
JOINQ = "JOIN qs ON qs.window_start = l.window_start AND qs.source = l.source"


@query(
    "win_14_standardize_robust",
    f"WITH {STD_LONG}{QSTATS} " + _std("lng", "CASE WHEN q3 - q1 < 1e-9 THEN 0.0 ELSE round((value - md) / (q3 - q1), 4) END", JOINQ),
)
def _(spark, d):
    return _std_only(A.standardize(durable(pivot(spark, d)), "robust"))


@query(
    "win_14_standardize_minmax",
    f"WITH {STD_LONG}{QSTATS} " + _std("lng", "CASE WHEN hi - lo < 1e-9 THEN 0.5 ELSE round((value - lo) / (hi - lo), 4) END", JOINQ),
)
def _(spark, d):
    return _std_only(A.standardize(durable(pivot(spark, d)), "minmax"))


@query(
    "win_14_standardize_log1p",
    f"WITH {STD_LONG}{QSTATS} " + _std("lng", "CASE WHEN lhi - llo < 1e-9 THEN 0.5 ELSE round((ln(1 + value) - llo) / (lhi - llo), 4) END", JOINQ),
)
def _(spark, d):
    return _std_only(A.standardize(durable(pivot(spark, d)), "log1p"))


RANK_EXPR = """CASE WHEN count(*) OVER (PARTITION BY l.window_start, l.source) <= 1 THEN 0.5 ELSE
  round((rank() OVER (PARTITION BY l.window_start, l.source ORDER BY value) - 1 + (count(*) OVER (PARTITION BY l.window_start, l.source, value) - 1) / 2.0)
    / (count(*) OVER (PARTITION BY l.window_start, l.source) - 1), 4) END"""


@query("win_14_standardize_rank", f"WITH {STD_LONG} " + _std("lng", RANK_EXPR))
def _(spark, d):
    return _std_only(A.standardize(durable(pivot(spark, d)), "rank"))


def _std_only(df):
    return df.select("topic_id", "window_start", *[f"{s}_count_std" for s in SRC])


SIGNALS = """sig AS (SELECT user_id AS repo_id, event_type AS topic_id, strftime(ts, '%Y-%m-%d') AS created_at, floor(value)::BIGINT AS stars_total,
  round(value / 7, 3) AS stars_per_day_lifetime, user_id % 9 AS forks_total, CASE WHEN value > 100 THEN 1 ELSE 0 END AS activity_recent FROM events)"""


@query(
    "join_05_extend_pivot",
    f"""WITH {PIVOT}, {SIGNALS}, m AS (SELECT topic_id, strftime(ts, '%Y-%m') AS window_start, count(*)::DOUBLE AS gdelt_count FROM
      (SELECT event_type AS topic_id, ts FROM events) GROUP BY 1, 2),
    s AS (SELECT topic_id, substr(created_at, 1, 7) AS window_start, sum(stars_total)::BIGINT AS a, sum(stars_per_day_lifetime) AS b,
      sum(forks_total)::BIGINT AS c, sum(activity_recent)::BIGINT AS e FROM sig WHERE topic_id <> 'error' GROUP BY 1, 2)
    SELECT m.topic_id, m.window_start, m.gdelt_count, coalesce(a, 0) AS github_stars_total, round(coalesce(b, 0), 3) AS github_stars_per_day,
      coalesce(c, 0) AS github_forks_total, coalesce(e, 0) AS github_activity_recent
    FROM m LEFT JOIN s ON s.topic_id = m.topic_id AND s.window_start = m.window_start""",
)
def _(spark, d):
    monthly = (
        B.table(spark, d, "events")
        .groupBy(F.col("event_type").alias("topic_id"), F.date_format("ts", "yyyy-MM").alias("window_start"))
        .agg(F.count(F.lit(1)).cast("double").alias("gdelt_count"))
    )
    out = A.extend_pivot(monthly, B.signals(spark, d).where("topic_id <> 'error'"))
    return out.withColumn("github_stars_per_day", F.round("github_stars_per_day", 3))


@query(
    "src_21_repo_topic_rollup",
    f"""WITH {SIGNALS} SELECT topic_id, count(*) AS repos_count, sum(stars_total)::BIGINT AS stars_total, sum(forks_total)::BIGINT AS forks_total,
    sum(activity_recent)::BIGINT AS activity_recent_count FROM sig GROUP BY 1""",
)
def _(spark, d):
    return repo_topic_rollup(B.signals(spark, d))


@query(
    "str_04_snapshot_delta",
    """WITH s AS (SELECT user_id::VARCHAR AS full_name, strftime(ts, '%Y-%m-%d') AS fetched_at, floor(max(value))::BIGINT AS stars FROM events GROUP BY 1, 2)
    SELECT full_name, fetched_at, stars, stars - lag(stars) OVER (PARTITION BY full_name ORDER BY fetched_at) AS delta FROM s""",
)
def _(spark, d):
    log = (
        B.table(spark, d, "events")
        .groupBy(F.col("user_id").cast("string").alias("full_name"), B.iso("ts").alias("fetched_at"))
        .agg(F.floor(F.max("value")).cast("bigint").alias("stars"))
    )
    return snapshot_delta(log)


COVER = TAGGED + ", cov AS (SELECT topic_id, min(topic_label) AS label, count(*) AS windows, 0::BIGINT AS filled_windows, " + ", ".join(
    f"count(*) FILTER (WHERE {s}_count > 0) / count(*)::DOUBLE AS {s}_coverage" for s in SRC
) + ", (" + " + ".join(f"count(*) FILTER (WHERE {s}_count > 0)" for s in SRC) + ") / (count(*) * 6)::DOUBLE AS overall_coverage FROM tagged GROUP BY 1)"


def _tagged(spark, d):
    return durable(A.tag_anomalies(durable(thin(spark, d))))


@query(
    "agg_15_topic_coverage",
    f"WITH {COVER} SELECT topic_id, label, windows, filled_windows, " + ", ".join(f"round({s}_coverage, 6) AS {s}_coverage" for s in SRC)
    + ", round(overall_coverage, 6) AS overall_coverage FROM cov",
)
def _(spark, d):
    out = A.topic_coverage(_tagged(spark, d))
    return out.select("topic_id", "label", "windows", "filled_windows", *[r6(f"{s}_coverage") for s in SRC], r6("overall_coverage"))


SCOV = TAGS + """, sc AS (SELECT replace(source, '_count', '') AS source, count(*) FILTER (WHERE value > 0) / count(*)::DOUBLE AS coverage,
  count(*) FILTER (WHERE zscore_outlier OR iqr_outlier OR zero_tag <> '') AS anomaly_count, count(*) AS total_windows FROM tags GROUP BY 1)"""


@query("agg_15_source_coverage", f"WITH {SCOV} SELECT source, round(coverage, 6) AS coverage, anomaly_count, total_windows FROM sc")
def _(spark, d):
    return A.source_coverage(_tagged(spark, d)).withColumn("coverage", r6("coverage"))


@query(
    "agg_15_quality_score",
    f"""WITH {COVER}, c AS (SELECT avg(overall_coverage) AS avg_coverage FROM cov),
    a AS (SELECT count(*) FILTER (WHERE zscore_outlier OR iqr_outlier OR zero_tag <> '') AS anomaly_cells, count(*) AS cells FROM tags)
    SELECT round(avg_coverage, 6) AS avg_coverage, anomaly_cells, cells, round(least(anomaly_cells / cells::DOUBLE, 0.2), 6) AS penalty,
      floor(greatest(0, (avg_coverage - least(anomaly_cells / cells::DOUBLE, 0.2)) * 100))::INT AS overall_score FROM c CROSS JOIN a""",
)
def _(spark, d):
    out = A.quality_score(_tagged(spark, d))
    return out.select(r6("avg_coverage"), "anomaly_cells", "cells", r6("penalty"), "overall_score")


@query(
    "agg_15_quality_issues",
    f"""WITH {COVER}, a AS (SELECT count(*) FILTER (WHERE zscore_outlier OR iqr_outlier OR zero_tag <> '') AS n FROM tags)
    SELECT printf('Topic %s: low coverage (%.1f%%)', topic_id, overall_coverage * 100) AS issue FROM cov WHERE overall_coverage < 0.3
    UNION ALL SELECT n || ' anomaly cells detected (see by_source for breakdown)' FROM a WHERE n > 0
    """ + " ".join(f"UNION ALL SELECT 'Topic ' || topic_id || ': no {s} data' FROM cov WHERE {s}_coverage = 0" for s in SRC),
)
def _(spark, d):
    return A.quality_issues(_tagged(spark, d))


@query(
    "src_23_month_windows",
    """SELECT strftime(d, '%Y-%m') AS window_start, strftime(d + INTERVAL 1 MONTH, '%Y-%m') AS window_end,
      strftime(d, '%Y-%m-%d') AS first_day, strftime(last_day(d::DATE), '%Y-%m-%d') AS last_day
    FROM generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT date_trunc('month', max(o_orderdate)) FROM orders), INTERVAL 1 MONTH) g(d)""",
)
def _(spark, d):
    span = B.table(spark, d, "orders").agg(
        F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("a"),
        F.date_format(F.add_months(F.max("o_orderdate"), 1), "yyyy-MM").alias("b"),
    ).first()
    return A.month_windows(spark, span["a"], span["b"])


# Whole chain: thinned pivot replaced by the plain records, filled to the day catalogue.
CHAIN = TAGS.replace("< 9 THEN", "< 0 THEN") + """,
dead AS (SELECT topic_id, window_start FROM tags t JOIN (SELECT source FROM tags GROUP BY 1 HAVING sum(value) > 0) a ON a.source = t.source
  GROUP BY 1, 2 HAVING bool_and(zero_tag = 'likely_api_failure')),
kept AS (SELECT * FROM thin ANTI JOIN dead USING (topic_id, window_start)),
cal AS (SELECT strftime(d, '%Y-%m-%d') AS window_start FROM generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE + 5 FROM events), INTERVAL 1 DAY) g(d)),
grid AS (SELECT t.topic_id, c.window_start FROM (SELECT DISTINCT topic_id FROM kept) t CROSS JOIN cal c),
""" + "filled AS (SELECT g.topic_id, g.window_start, " + ", ".join(
    f"coalesce(last_value(p.{s}_count IGNORE NULLS) OVER w, 0) AS {s}_count" for s in SRC
) + """ FROM grid g LEFT JOIN kept p ON p.topic_id = g.topic_id AND p.window_start = g.window_start
  WINDOW w AS (PARTITION BY g.topic_id ORDER BY g.window_start ROWS UNBOUNDED PRECEDING)),
lng AS (""" + _long("filled") + ")" + QSTATS + """, std AS (SELECT l.*, CASE WHEN q3 - q1 < 1e-9 THEN 0.0 ELSE round((value - md) / (q3 - q1), 4) END AS std,
  round(median(value) OVER (PARTITION BY topic_id, l.source ORDER BY l.window_start ROWS 2 PRECEDING), 2) AS smoothed FROM lng l """ + JOINQ + ")"


@query(
    "act_01_activity_chain",
    f"WITH {CHAIN} SELECT topic_id, window_start, " + ", ".join(
        f"max(CASE WHEN source = '{s}_count' THEN value END) AS {s}_count, max(CASE WHEN source = '{s}_count' THEN std END) AS {s}_count_std, "
        f"max(CASE WHEN source = '{s}_count' THEN smoothed END) AS {s}_count_smoothed"
        for s in SRC
    ) + " FROM std GROUP BY 1, 2",
)
def _(spark, d):
    out = activity_chain(B.records(spark, d), B.day_windows(spark, d))
    return out.select("topic_id", "window_start", *[f"{s}_count{x}" for s in SRC for x in ("", "_std", "_smoothed")])
