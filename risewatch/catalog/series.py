"""Queries over concept activity: counts, features, bursts, stages, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from risewatch import bindings as B
from risewatch.catalog.registry import CITATIONS, COUNTS, DENSE, MENTIONS, query
from risewatch.functions import sql
from risewatch.operators import bursts, citations, lifecycle, series
from risewatch.operators.fusion import rank_normalize
from risewatch.session import durable


def lazy_counts(spark, d):
    return series.bin_counts(B.mentions(spark, d))


def counts(spark, d):
    """Counts stored once per query: the mentions are scanned a single time."""
    return durable(lazy_counts(spark, d))


def r6(c: str):
    return F.round(c, 6).alias(c)


@query("agg_01_concept_bin_counts", f"WITH {COUNTS} SELECT entity, bin, cnt FROM counts")
def _(spark, d):
    return lazy_counts(spark, d)


@query(
    "agg_01_work_concept_bin_counts",
    """WITH w AS (SELECT strftime(o_orderdate, '%Y-%m') AS bin, o_orderpriority, o_orderstatus, c_mktsegment, n_name,
         n_regionkey, strftime(o_orderdate, '%Y') AS y
       FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
     m AS (SELECT 'P' || substr(o_orderpriority, 1, 1) AS entity, bin FROM w UNION ALL SELECT 'S' || o_orderstatus, bin FROM w
       UNION ALL SELECT 'M' || c_mktsegment, bin FROM w UNION ALL SELECT 'N' || n_name, bin FROM w
       UNION ALL SELECT 'R' || n_regionkey, bin FROM w UNION ALL SELECT 'Y' || y, bin FROM w)
     SELECT entity, bin, count(*) AS cnt FROM m GROUP BY 1, 2""",
)
def _(spark, d):
    return series.bin_counts(series.mention_rows(B.works(spark, d)))


@query("agg_02_dense_grid", f"WITH {DENSE} SELECT entity, bin, x::BIGINT AS cnt FROM dense")
def _(spark, d):
    return series.densify(counts(spark, d))


@query("agg_03_bin_totals", f"WITH {COUNTS} SELECT bin, sum(cnt)::BIGINT AS total FROM counts GROUP BY 1")
def _(spark, d):
    return series.bin_totals(lazy_counts(spark, d))


@query("agg_03_entity_totals", f"WITH {COUNTS} SELECT entity, sum(cnt)::BIGINT AS total FROM counts GROUP BY 1")
def _(spark, d):
    return series.entity_totals(lazy_counts(spark, d))


@query(
    "agg_07_future_growth",
    f"""WITH {DENSE} SELECT entity,
      round(avg(CASE WHEN ord > n - 6 THEN x END) - avg(CASE WHEN ord <= n - 6 THEN x END), 6) AS growth
    FROM dense GROUP BY 1""",
)
def _(spark, d):
    return series.future_growth(counts(spark, d), 6).select("entity", r6("growth"))


@query(
    "agg_08_future_activity",
    f"WITH {DENSE} SELECT entity, round(avg(x), 6) AS activity FROM dense WHERE ord > n - 6 GROUP BY 1",
)
def _(spark, d):
    return series.future_activity(counts(spark, d), 6).select("entity", r6("activity"))


EMA = DENSE.replace("mentions AS", "RECURSIVE mentions AS", 1) + """, ema AS (
  SELECT entity, ord, x AS e3, x AS e6 FROM dense WHERE ord = 1
  UNION ALL
  SELECT d.entity, d.ord, d.x * 0.5 + p.e3 * 0.5, d.x * (2.0 / 7.0) + p.e6 * (5.0 / 7.0)
  FROM ema p JOIN dense d ON d.entity = p.entity AND d.ord = p.ord + 1)"""


@query(
    "win_01_ema",
    f"WITH {EMA} SELECT entity, round(e3, 6) AS ema FROM ema WHERE ord = (SELECT max(ord) FROM bins)",
)
def _(spark, d):
    return series.ema(counts(spark, d), 3).select("entity", r6("ema"))


@query(
    "win_02_macd",
    f"WITH {EMA} SELECT entity, round(e3 - e6, 6) AS macd FROM ema WHERE ord = (SELECT max(ord) FROM bins)",
)
def _(spark, d):
    return series.macd(counts(spark, d)).select("entity", r6("macd"))


@query(
    "win_03_share_series",
    f"""WITH {DENSE} SELECT entity, bin,
      round((x + 1) / (sum(x) OVER (PARTITION BY bin) + (SELECT count(DISTINCT entity) FROM counts)), 9) AS share
    FROM dense""",
)
def _(spark, d):
    return series.share_series(counts(spark, d)).withColumn("share", F.round("share", 9))


# Features and scores with the last six bins held out.
FEATURES = DENSE.replace("mentions AS", "RECURSIVE mentions AS", 1) + """, hist AS (
  SELECT entity, ord, n - 6 AS n, x,
         (x + 1) / (sum(x) OVER (PARTITION BY bin) + (SELECT count(DISTINCT entity) FROM counts)) AS s
  FROM dense WHERE ord <= n - 6),
walk AS (
  SELECT entity, ord, n, x AS e3, x AS e6, s AS s3, s AS s6 FROM hist WHERE ord = 1
  UNION ALL
  SELECT h.entity, h.ord, h.n, h.x * 0.5 + p.e3 * 0.5, h.x * (2.0 / 7.0) + p.e6 * (5.0 / 7.0),
         h.s * 0.5 + p.s3 * 0.5, h.s * (2.0 / 7.0) + p.s6 * (5.0 / 7.0)
  FROM walk p JOIN hist h ON h.entity = p.entity AND h.ord = p.ord + 1),
steps AS (
  SELECT entity, ord, n, x, ln(1 + x) - lag(ln(1 + x)) OVER (PARTITION BY entity ORDER BY ord) AS g FROM hist),
feats AS (
  SELECT w.entity, w.e3 AS ema_short, w.e3 - w.e6 AS macd, (w.s3 - w.s6) / (w.s6 + 1e-6) AS relative_growth,
         v.stability, v.persistence
  FROM walk w JOIN (SELECT entity, -coalesce(stddev_samp(g), 0) AS stability,
                           avg(CASE WHEN ord > n - 12 THEN CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END END) AS persistence
                    FROM steps GROUP BY 1) v ON v.entity = w.entity
  WHERE w.ord = w.n)"""


@query(
    "win_04_relative_growth",
    f"WITH {FEATURES} SELECT entity, round(relative_growth, 6) AS relative_growth FROM feats",
)
def _(spark, d):
    return series.share_features(counts(spark, d), holdout=6).select("entity", r6("relative_growth"))


@query("win_05_volatility", f"WITH {FEATURES} SELECT entity, round(-stability, 6) AS volatility FROM feats")
def _(spark, d):
    return series.share_features(counts(spark, d), holdout=6).select(
        "entity", F.round(-F.col("stability"), 6).alias("volatility")
    )


@query(
    "win_06_persistence",
    f"""WITH {DENSE} SELECT entity, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS persistence
    FROM dense WHERE ord > n - 12 GROUP BY 1""",
)
def _(spark, d):
    return series.persistence(counts(spark, d), 12).select("entity", r6("persistence"))


@query(
    "win_15_cumulative_activity",
    f"""WITH {DENSE} SELECT entity, bin, (sum(x) OVER (PARTITION BY entity ORDER BY ord))::BIGINT AS cum FROM dense""",
)
def _(spark, d):
    return series.cumulate(counts(spark, d)).select("entity", "bin", "cum")


def _normalized(col: str) -> str:
    return f"""(SELECT entity, CASE WHEN n < 2 THEN 0.5 WHEN q3 - q1 = 0 AND hi - lo <= 1e-9 * greatest(abs(lo), abs(hi)) THEN 0.5
        WHEN q3 - q1 = 0 THEN (v - lo) / (hi - lo)
        ELSE 1 / (1 + exp(-greatest(-35, least(35, (v - med) / ((q3 - q1) / 1.34896))))) END AS z
      FROM (SELECT entity, {col} AS v, count(*) OVER () AS n, min({col}) OVER () AS lo, max({col}) OVER () AS hi FROM feats)
      CROSS JOIN (SELECT max(CASE WHEN rn - 1 = n // 4 THEN v END) AS q1, max(CASE WHEN rn - 1 = n // 2 THEN v END) AS med,
                         max(CASE WHEN rn - 1 = (n * 3) // 4 THEN v END) AS q3
                  FROM (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) AS rn, count(*) OVER () AS n FROM feats)))"""


MOMENTUM = FEATURES + f""", momentum AS (
  SELECT a.entity, 0.25 * a.z + 0.30 * b.z + 0.20 * c.z + 0.125 * d.z + 0.125 * e.z AS score
  FROM {_normalized('ema_short')} a JOIN {_normalized('macd')} b ON b.entity = a.entity
  JOIN {_normalized('relative_growth')} c ON c.entity = a.entity JOIN {_normalized('stability')} d ON d.entity = a.entity
  JOIN {_normalized('persistence')} e ON e.entity = a.entity)"""


@query(
    "rnk_01_robust_normalize",
    f"""WITH {COUNTS}, feats AS (SELECT entity, sum(cnt)::DOUBLE AS total FROM counts GROUP BY 1)
    SELECT entity, round(z, 6) AS scaled FROM {_normalized('total')}""",
)
def _(spark, d):
    totals = series.entity_totals(counts(spark, d))
    return series.robust_normalize(totals, ["total"]).select("entity", F.round("total_norm", 6).alias("scaled"))


@query("rnk_02_share_momentum", f"WITH {MOMENTUM} SELECT entity, round(score, 6) AS score FROM momentum")
def _(spark, d):
    return series.share_momentum(counts(spark, d), holdout=6).select("entity", r6("score"))


@query(
    "rnk_03_share_momentum_topk",
    f"""WITH {MOMENTUM} SELECT entity, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, entity)::INT AS pos
    FROM momentum ORDER BY score DESC, entity LIMIT 10""",
)
def _(spark, d):
    return series.share_momentum_topk(counts(spark, d), 10, holdout=6).select("entity", r6("score"), "pos")


# Two-state Viterbi walk over dense series.
BURSTS = DENSE.replace("mentions AS", "RECURSIVE mentions AS", 1) + """, cost AS (
  SELECT d.entity, d.ord, d.n, d.x, r.rate - d.x * ln(r.rate) AS k0, 2 * r.rate - d.x * ln(2 * r.rate) AS k1, ln(d.n) AS tau
  FROM dense d JOIN (SELECT entity, avg(x) AS rate FROM dense GROUP BY 1) r ON r.entity = d.entity),
vit AS (
  SELECT entity, ord, n, k0 AS c0, k1 AS c1, '0' AS p0, '1' AS p1 FROM cost WHERE ord = 1
  UNION ALL
  SELECT c.entity, c.ord, c.n,
    CASE WHEN v.c0 <= v.c1 + c.tau THEN v.c0 ELSE v.c1 + c.tau END + c.k0,
    CASE WHEN v.c0 + c.tau <= v.c1 THEN v.c0 + c.tau ELSE v.c1 END + c.k1,
    (CASE WHEN v.c0 <= v.c1 + c.tau THEN v.p0 ELSE v.p1 END) || '0',
    (CASE WHEN v.c0 + c.tau <= v.c1 THEN v.p0 ELSE v.p1 END) || '1'
  FROM vit v JOIN cost c ON c.entity = v.entity AND c.ord = v.ord + 1),
states AS (
  SELECT d.entity, d.ord, d.x, substr(CASE WHEN v.c0 <= v.c1 THEN v.p0 ELSE v.p1 END, d.ord::INT, 1) AS st
  FROM dense d JOIN vit v ON v.entity = d.entity AND v.ord = v.n),
segs AS (
  SELECT entity, min(ord) - 1 AS s, max(ord) - 1 AS e, max(x) AS weight
  FROM (SELECT *, ord - row_number() OVER (PARTITION BY entity, st ORDER BY ord) AS grp FROM states)
  WHERE st = '1' GROUP BY entity, grp)"""


def _tuned(s: float, gamma: float) -> str:
    """The same walk with other rates and switching costs."""
    return BURSTS.replace("2 * r.rate", f"{s} * r.rate").replace("ln(d.n) AS tau", f"{gamma} * ln(d.n) AS tau")


@query(
    "win_21_kleinberg_bursts",
    f"""WITH {_tuned(1.25, 0.25)} SELECT entity, s::INT AS "start", e::INT AS "end", weight FROM segs""",
)
def _(spark, d):
    return bursts.kleinberg_bursts(counts(spark, d), s=1.25, gamma=0.25)


@query(
    "udf_03_sql_bursts",
    f"""WITH {_tuned(1.25, 0.25)} SELECT e.entity, coalesce(max(s.weight), 0)::DOUBLE AS weight, count(s.weight) AS n_bursts
    FROM (SELECT DISTINCT entity FROM dense) e LEFT JOIN segs s ON s.entity = e.entity GROUP BY 1""",
)
def _(spark, d):
    sql.register(spark)
    series.series_arrays(counts(spark, d)).createOrReplaceTempView("burst_series")
    return spark.sql(
        """SELECT entity, coalesce(array_max(transform(b, x -> x.weight)), 0D) AS weight, cast(size(b) AS bigint) AS n_bursts
        FROM (SELECT entity, burst_array(x, 1.25D, 0.25D) AS b FROM burst_series)"""
    )


@query("udf_04_sql_burst_rows", f"""WITH {_tuned(1.25, 0.25)} SELECT entity, s::INT AS "start", e::INT AS "end", weight FROM segs""")
def _(spark, d):
    sql.register(spark)
    series.series_arrays(counts(spark, d)).createOrReplaceTempView("burst_series")
    return spark.sql("SELECT entity, b.start, b.`end`, b.weight FROM burst_series, LATERAL burst_rows(x, 1.25D, 0.25D) AS b")


@query(
    "rnk_04_burst_topk",
    f"""WITH {_tuned(1.25, 0.25)} SELECT e.entity, coalesce(max(s.weight), 0)::DOUBLE AS weight, count(s.weight)::INT AS n_bursts,
      row_number() OVER (ORDER BY coalesce(max(s.weight), 0) DESC, e.entity)::INT AS pos
    FROM (SELECT DISTINCT entity FROM dense) e LEFT JOIN segs s ON s.entity = e.entity
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(spark, d):
    return bursts.burst_topk(counts(spark, d), 10, s=1.25, gamma=0.25)


@query(
    "rnk_05_growth_topk",
    f"""WITH {DENSE}, g AS (SELECT entity, avg(CASE WHEN ord > n - 6 THEN x END) - avg(CASE WHEN ord <= n - 6 THEN x END) AS growth
      FROM dense GROUP BY 1)
    SELECT entity, round(growth, 6) AS growth, row_number() OVER (ORDER BY growth DESC, entity)::INT AS pos FROM g
    ORDER BY growth DESC, entity LIMIT 10""",
)
def _(spark, d):
    return series.growth_topk(counts(spark, d), 6, 10).select("entity", r6("growth"), "pos")


@query(
    "rnk_06_rank_normalize",
    f"""WITH {COUNTS}, t AS (SELECT entity, sum(cnt)::DOUBLE AS score FROM counts GROUP BY 1)
    SELECT entity, score, round((count(*) OVER () - row_number() OVER (ORDER BY score DESC, entity))
      / (count(*) OVER () - 1)::DOUBLE, 6) AS scaled FROM t""",
)
def _(spark, d):
    totals = series.entity_totals(lazy_counts(spark, d)).select("entity", F.col("total").cast("double").alias("score"))
    return rank_normalize(totals).select("entity", "score", r6("scaled"))


@query(
    "rnk_11_top_active",
    f"""WITH {COUNTS}, t AS (SELECT entity, sum(cnt)::BIGINT AS total FROM counts GROUP BY 1)
    SELECT entity, total, row_number() OVER (ORDER BY total DESC, entity)::INT AS pos FROM t ORDER BY total DESC, entity LIMIT 20""",
)
def _(spark, d):
    return series.top_active(lazy_counts(spark, d), 20)


@query(
    "rnk_13_trend_series",
    f"""WITH {DENSE}, t AS (SELECT entity FROM counts GROUP BY 1 ORDER BY sum(cnt) DESC, entity LIMIT 6)
    SELECT d.entity, d.bin, d.x::BIGINT AS cnt FROM dense d JOIN t ON t.entity = d.entity""",
)
def _(spark, d):
    return series.trend_series(counts(spark, d), 6)


# S-curve stages over cumulative counts.
STAGE_CASE = """CASE WHEN n < 3 THEN 'emerging' WHEN total <= 0 THEN 'emerging' WHEN n < 12 THEN 'emerging'
      WHEN total < threshold THEN 'emerging' WHEN total - piv <= 0 THEN 'declining' WHEN piv - fst <= 0 THEN 'growth'
      WHEN total - piv > piv - fst THEN 'growth' ELSE 'mature' END"""
STAGES = f""", cum AS (SELECT entity, bin, ord, n, sum(x) OVER (PARTITION BY entity ORDER BY ord) AS c FROM dense),
pts AS (SELECT entity, max(n) AS n, max(CASE WHEN ord = n THEN c END) AS total,
          max(CASE WHEN ord = n - least(6, n - 1) THEN c END) AS piv, max(CASE WHEN ord = 1 THEN c END) AS fst
        FROM cum GROUP BY 1),
stages AS (SELECT entity, total, {STAGE_CASE} AS stage
           FROM pts CROSS JOIN (SELECT quantile_cont(total, 0.2) AS threshold FROM pts))"""


@query(
    "win_22_s_curve_stage",
    f"WITH {DENSE}{STAGES.replace('WHEN total < threshold', 'WHEN false')} SELECT entity, total::BIGINT AS total, stage FROM stages",
)
def _(spark, d):
    points = lifecycle.stage_points(counts(spark, d))
    return lifecycle.stage_of(points, threshold=None).select("entity", "total", "stage")


@query(
    "win_23_concept_stages",
    f"WITH {DENSE}{STAGES} SELECT entity, total::BIGINT AS total, stage FROM stages",
)
def _(spark, d):
    return lifecycle.concept_stages(counts(spark, d))


CURVE = """ SELECT CASE s.stage WHEN 'emerging' THEN 0 WHEN 'growth' THEN 1 WHEN 'mature' THEN 2 ELSE 3 END::INT AS stage_order,
  s.stage, c.bin, round(avg(c.c / CASE WHEN s.total = 0 THEN 1 ELSE s.total END), 6) AS level
FROM cum c JOIN stages s ON s.entity = c.entity GROUP BY ALL"""


@query("win_24_stage_curves", f"WITH {DENSE}{STAGES}{CURVE}")
def _(spark, d):
    c = counts(spark, d)
    return lifecycle.stage_curves(c, lifecycle.concept_stages(c)).select("stage_order", "stage", "bin", r6("level"))


@query("agg_19_stage_distribution", f"WITH {DENSE}{STAGES} SELECT stage, count(*) AS n FROM stages GROUP BY 1")
def _(spark, d):
    return lifecycle.stage_distribution(lifecycle.concept_stages(counts(spark, d)))


# Citations: parts cited by orders.
def facts(spark, d):
    return citations.forward_citations(B.backward_citations(spark, d))


@query(
    "flt_06_forward_citations",
    f"""WITH {CITATIONS} SELECT head, 'cited_by' AS relation, tail, time, '' AS head_date, 'patent_citation' AS source
    FROM cites WHERE time >= '1996-01-01' AND time <= '2000-06-30'""",
)
def _(spark, d):
    return citations.forward_citations(B.backward_citations(spark, d), "1996-01-01", "2000-06-30")


@query(
    "agg_09_cited_totals",
    f"WITH {CITATIONS} SELECT head AS entity, count(*) AS total FROM cites GROUP BY 1 HAVING count(*) >= 2",
)
def _(spark, d):
    return citations.cited_totals(citations.citation_counts(facts(spark, d)))


SAMPLE = CITATIONS + """, totals AS (SELECT head AS entity, count(*) AS total FROM cites GROUP BY 1 HAVING count(*) >= 2),
lv AS (SELECT *, log10(total + 1) AS v FROM totals), sp AS (SELECT min(v) AS lo, max(v) AS hi FROM lv),
strata AS (SELECT entity, total, least(4, floor((v - lo) / CASE WHEN hi > lo THEN (hi - lo) / 5 ELSE 1 END))::INT AS stratum FROM lv CROSS JOIN sp),
sampled AS (SELECT entity, total, stratum FROM strata
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY total DESC, entity) <= 50)"""


@query("rnk_12_stratified_patents", f"WITH {SAMPLE} SELECT entity, total, stratum FROM sampled")
def _(spark, d):
    totals = citations.cited_totals(citations.citation_counts(facts(spark, d)))
    return citations.sample_patents(totals, per_bin=50)


@query(
    "rnk_12_top_total_patents",
    f"WITH {SAMPLE} SELECT entity, total FROM totals ORDER BY total DESC, entity LIMIT 100",
)
def _(spark, d):
    totals = citations.cited_totals(citations.citation_counts(facts(spark, d)))
    return citations.sample_patents(totals, "top_total", max_patents=100)


CITE_DENSE = CITATIONS + """, totals AS (SELECT head AS entity FROM cites GROUP BY 1 HAVING count(*) >= 2), counts AS (SELECT c.head AS entity, substr(c.time, 1, 7) AS bin, count(*) AS cnt
  FROM cites c JOIN totals s ON s.entity = c.head GROUP BY 1, 2),
bins AS (SELECT bin, row_number() OVER (ORDER BY bin) AS ord, count(*) OVER () AS n FROM (SELECT DISTINCT bin FROM counts)),
dense AS (SELECT e.entity, b.bin, b.ord, b.n, coalesce(c.cnt, 0)::DOUBLE AS x
  FROM (SELECT DISTINCT entity FROM counts) e CROSS JOIN bins b LEFT JOIN counts c ON c.entity = e.entity AND c.bin = b.bin)"""


@query(
    "agg_10_cumulative_citations",
    f"WITH {CITE_DENSE} SELECT entity, bin, (sum(x) OVER (PARTITION BY entity ORDER BY ord))::BIGINT AS cum FROM dense",
)
def _(spark, d):
    return citations.cumulative_citations(facts(spark, d)).select("entity", "bin", "cum")


@query("win_23_citation_stages", f"WITH {CITE_DENSE}{STAGES} SELECT entity, total::BIGINT AS total, stage FROM stages")
def _(spark, d):
    return lifecycle.concept_stages(durable(citations.kept_counts(facts(spark, d))))


@query(
    "join_11_keep_top_cited",
    f"""WITH {CITATIONS}, t AS (SELECT head FROM cites GROUP BY 1 ORDER BY count(*) DESC, head LIMIT 25)
    SELECT c.head, c.tail, c.time FROM cites c JOIN t ON t.head = c.head""",
)
def _(spark, d):
    return citations.keep_top_cited(facts(spark, d), 25).select("head", "tail", "time")


@query(
    "join_09_names",
    f"""WITH {MENTIONS}, n AS (SELECT entity, min(doc_id) AS first_doc FROM mentions WHERE doc_id % 3 = 0 GROUP BY 1),
    t AS (SELECT entity, count(*) AS total FROM mentions GROUP BY 1)
    SELECT t.entity, t.total, coalesce('seen in ' || n.first_doc, '') AS name FROM t LEFT JOIN n ON n.entity = t.entity""",
)
def _(spark, d):
    from risewatch.operators.extract import with_names

    m = B.mentions(spark, d)
    named = m.select(
        "entity",
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("seen in "), F.col("doc_id").cast("string"))).alias("name"),
    )
    totals = m.groupBy("entity").agg(F.count(F.lit(1)).alias("total"))
    return with_names(totals, named, F.col("doc_id"))


@query(
    "flt_02_valid_time",
    f"WITH {MENTIONS} SELECT doc_id, entity, time FROM mentions WHERE time <= '1999-12-31' AND time <> ''",
)
def _(spark, d):
    from risewatch.operators.extract import valid_time

    return valid_time(B.mentions(spark, d), "1999-12-31").select("doc_id", "entity", "time")


@query(
    "flt_03_screening_concepts",
    f"WITH {COUNTS} SELECT entity, bin, cnt FROM counts WHERE entity NOT IN ('cold rod', 'new ring')",
)
def _(spark, d):
    from risewatch.operators.extract import drop_concepts

    return drop_concepts(lazy_counts(spark, d), ["cold rod", "new ring"])


@query(
    "rnk_14_document_top_elements",
    f"""WITH {MENTIONS} SELECT doc_id, entity, round(score, 2) AS score, pos FROM mentions
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, entity) <= 2""",
)
def _(spark, d):
    from pyspark.sql import Window as W

    order = W.partitionBy("doc_id").orderBy(F.desc("score"), "pos", "entity")
    return (
        B.mentions(spark, d)
        .withColumn("rn", F.row_number().over(order))
        .where("rn <= 2")  # cut on the map side before the shuffle
        .select("doc_id", "entity", F.round("score", 2).alias("score"), "pos")
    )


__all__ = ["counts", "facts"]
