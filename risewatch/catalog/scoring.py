"""Queries over metrics, fusion, verdicts and walk-forward evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from risewatch import bindings as B
from risewatch.catalog.registry import COUNTS, DENSE, MENTIONS, query
from risewatch.catalog.series import MOMENTUM, _tuned, counts, r6
from risewatch.operators import fusion, metrics, series
from risewatch.plans import backtest

PAIR = DENSE + """, truth AS (SELECT entity, avg(CASE WHEN ord > n - 6 THEN x END) - avg(CASE WHEN ord <= n - 6 THEN x END) AS g,
  avg(CASE WHEN ord > n - 6 THEN x END) AS rel, sum(x) FILTER (WHERE ord <= n - 6) AS past FROM dense GROUP BY 1),
ranked AS (SELECT entity, row_number() OVER (ORDER BY past DESC, entity) AS pos, past FROM truth QUALIFY pos <= 10),
best AS (SELECT entity FROM truth ORDER BY g DESC, entity LIMIT 10)"""


def _ranked(spark, d):
    c = counts(spark, d)
    hist = series.indexed(c).where("ord <= n_bins - 6").groupBy("entity").agg(F.sum("cnt").alias("past"))
    past = c.select("entity").distinct().join(hist, "entity", "left").fillna(0, subset=["past"])
    from risewatch.operators.core import top_k

    return c, past, top_k(past, "past", 10)


@query(
    "met_01_precision_at_k",
    f"WITH {PAIR} SELECT round(count(b.entity) / count(*)::DOUBLE, 6) AS precision_at_k FROM ranked r LEFT JOIN best b ON b.entity = r.entity",
)
def _(spark, d):
    c, _, ranked = _ranked(spark, d)
    return metrics.precision_at_k(ranked, series.growth_topk(c), 10).select(r6("precision_at_k"))


@query(
    "met_02_recall_at_k",
    f"WITH {PAIR} SELECT round(count(r.entity) / count(*)::DOUBLE, 6) AS recall_at_k FROM best b LEFT JOIN ranked r ON b.entity = r.entity",
)
def _(spark, d):
    c, _, ranked = _ranked(spark, d)
    return metrics.recall_at_k(ranked, series.growth_topk(c), 10).select(r6("recall_at_k"))


RANKS = "(SELECT l_linenumber * 0.5 + l_quantity AS rank FROM lineitem)"


def _ranks(spark, d):
    return B.table(spark, d, "lineitem").select((F.col("l_linenumber") * 0.5 + F.col("l_quantity")).alias("rank"))


@query("met_03_mrr", f"SELECT round(avg(1.0 / rank), 6) AS mrr FROM {RANKS}")
def _(spark, d):
    return metrics.mrr(_ranks(spark, d)).select(r6("mrr"))


@query(
    "met_04_hits_at",
    f"""SELECT round(avg((rank <= 1)::INT), 6) AS hits_at_1, round(avg((rank <= 3)::INT), 6) AS hits_at_3,
    round(avg((rank <= 10)::INT), 6) AS hits_at_10 FROM {RANKS}""",
)
def _(spark, d):
    return metrics.hits_at(_ranks(spark, d)).select(r6("hits_at_1"), r6("hits_at_3"), r6("hits_at_10"))


@query(
    "met_05_mae_rmse",
    """SELECT round(avg(abs(l_quantity - l_linenumber * 7)), 6) AS mae,
    round(sqrt(avg((l_quantity - l_linenumber * 7) ** 2)), 6) AS rmse FROM lineitem""",
)
def _(spark, d):
    pair = B.table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("actual"), (F.col("l_linenumber") * 7).cast("double").alias("forecast")
    )
    return metrics.regression_errors(pair).select(r6("mae"), r6("rmse"))


@query(
    "met_06_mape",
    """SELECT round(avg(abs(l_discount * 100 - l_linenumber) / abs(l_discount * 100)), 6) AS mape
    FROM lineitem WHERE l_discount <> 0""",
)
def _(spark, d):
    pair = B.table(spark, d, "lineitem").select(
        (F.col("l_discount") * 100).alias("actual"), F.col("l_linenumber").cast("double").alias("forecast")
    )
    return metrics.regression_errors(pair).select(r6("mape"))


@query(
    "met_07_spearman",
    f"""WITH {PAIR}, r AS (SELECT row_number() OVER (ORDER BY coalesce(past, 0) DESC, entity) AS a,
      row_number() OVER (ORDER BY rel DESC, entity) AS b FROM truth)
    SELECT round(1 - 6 * sum((a - b) ** 2) / (count(*)::DOUBLE * (count(*)::DOUBLE ** 2 - 1)), 6) AS spearman_rho FROM r""",
)
def _(spark, d):
    c, past, _ = _ranked(spark, d)
    true = series.future_activity(c, 6).withColumnRenamed("activity", "score")
    return metrics.spearman(past.withColumnRenamed("past", "score"), true).select(r6("spearman_rho"))


@query(
    "met_08_ndcg_at_k",
    f"""WITH {PAIR}, got AS (SELECT sum((2.0 ** t.rel - 1) / log2(r.pos + 1)) AS dcg FROM ranked r JOIN truth t ON t.entity = r.entity WHERE r.pos <= 5),
    ideal AS (SELECT sum((2.0 ** rel - 1) / log2(p + 1)) AS idcg FROM (SELECT rel, row_number() OVER (ORDER BY rel DESC, entity) AS p FROM truth) WHERE p <= 5)
    SELECT round(dcg / idcg, 6) AS ndcg_at_5 FROM got CROSS JOIN ideal""",
)
def _(spark, d):
    c, _, ranked = _ranked(spark, d)
    rel = series.future_activity(c, 6).withColumnRenamed("activity", "rel")
    return metrics.ndcg_at_k(ranked, rel, 5).select(r6("ndcg_at_5"))


@query(
    "met_09_top1_lift",
    f"""WITH {PAIR} SELECT round(max(CASE WHEN r.pos = 1 THEN t.rel END) / avg(t.rel), 6) AS top1_lift
    FROM ranked r JOIN truth t ON t.entity = r.entity""",
)
def _(spark, d):
    c, _, ranked = _ranked(spark, d)
    rel = series.future_activity(c, 6).withColumnRenamed("activity", "rel")
    return metrics.top1_lift(ranked, rel).select(r6("top1_lift"))


@query(
    "set_05_list_overlap",
    f"WITH {PAIR} SELECT r.entity FROM ranked r JOIN best b ON b.entity = r.entity",
)
def _(spark, d):
    c, _, ranked = _ranked(spark, d)
    return ranked.join(series.growth_topk(c).select("entity"), "entity", "left_semi").select("entity")


# Three score tables over the same concepts, each leaving some concepts out.
PARTS = COUNTS + """, t AS (SELECT entity, sum(cnt)::DOUBLE AS total, count(*)::DOUBLE AS active, max(cnt)::DOUBLE AS peak FROM counts GROUP BY 1),
a AS (SELECT entity, total AS score FROM t WHERE entity NOT LIKE 'c%'),
b AS (SELECT entity, active AS score FROM t WHERE entity NOT LIKE 'n%'),
c AS (SELECT entity, peak AS score FROM t WHERE entity NOT LIKE 's%')"""


def _parts(spark, d):
    t = series.bin_counts(B.mentions(spark, d)).groupBy("entity").agg(
        F.sum("cnt").cast("double").alias("total"),
        F.count(F.lit(1)).cast("double").alias("active"),
        F.max("cnt").cast("double").alias("peak"),
    )
    pick = lambda c, p: t.where(~F.col("entity").startswith(p)).select("entity", F.col(c).alias("score"))
    return pick("total", "c"), pick("active", "n"), pick("peak", "s")


@query(
    "join_10_outer_scores",
    f"""WITH {PARTS} SELECT coalesce(a.entity, b.entity, c.entity) AS entity, coalesce(a.score, 0) AS burst, coalesce(b.score, 0) AS tkg,
      coalesce(c.score, 0) AS forecast, a.entity IS NOT NULL AS has_burst, b.entity IS NOT NULL AS has_tkg, c.entity IS NOT NULL AS has_forecast
    FROM a FULL JOIN b ON a.entity = b.entity FULL JOIN c ON c.entity = coalesce(a.entity, b.entity)""",
)
def _(spark, d):
    a, b, c = _parts(spark, d)
    return fusion.outer_scores({"burst": a, "tkg": b, "forecast": c})


def _scaled(t: str) -> str:
    return f"""(SELECT entity, score, CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE (count(*) OVER () - row_number() OVER (ORDER BY score DESC, entity))
      / (count(*) OVER () - 1)::DOUBLE END AS z FROM {t})"""


@query(
    "rnk_08_fusion_topk",
    f"""WITH {PARTS}, j AS (SELECT coalesce(x.entity, y.entity, w.entity) AS entity, coalesce(x.z, 0) AS burst, coalesce(y.z, 0) AS tkg, coalesce(w.z, 0) AS forecast
      FROM {_scaled('a')} x FULL JOIN {_scaled('b')} y ON x.entity = y.entity FULL JOIN {_scaled('c')} w ON w.entity = coalesce(x.entity, y.entity)),
    s AS (SELECT *, burst * 0.3 + tkg * 0.4 + forecast * 0.3 AS score FROM j)
    SELECT entity, round(score, 6) AS score, round(burst, 6) AS burst, round(tkg, 6) AS tkg, round(forecast, 6) AS forecast,
      row_number() OVER (ORDER BY score DESC, entity)::INT AS pos FROM s ORDER BY s.score DESC, entity LIMIT 10""",
)
def _(spark, d):
    a, b, c = _parts(spark, d)
    return fusion.fuse(a, b, c, k=10).select("entity", r6("score"), r6("burst"), r6("tkg"), r6("forecast"), "pos")


@query(
    "rnk_09_forecast_signal",
    f"""WITH {PARTS} SELECT entity, round((peak - total / 80) / greatest(total / 80, 1e-6), 6) AS score FROM t""",
)
def _(spark, d):
    t = series.bin_counts(B.mentions(spark, d)).groupBy("entity").agg(F.sum("cnt").alias("s"), F.max("cnt").alias("m"))
    fc = t.select("entity", (F.col("s") / 80).alias("recent_mean"), F.col("m").cast("double").alias("forecast"))
    return fusion.forecast_signal(fc).select("entity", r6("score"))


EXAMINE = PARTS + f""", x AS (SELECT coalesce(a1.entity, b1.entity) AS entity, a1.score AS signal_score, b1.score AS link_score,
    coalesce(a1.z, 0) AS sr, coalesce(b1.z, 0) AS lr, a1.entity IS NOT NULL AS hs, b1.entity IS NOT NULL AS hl
  FROM {_scaled('a')} a1 FULL JOIN {_scaled('b')} b1 ON a1.entity = b1.entity),
verdicts AS (SELECT entity, CASE WHEN sr >= 0.5 AND lr >= 0.5 THEN 'agree' WHEN sr >= 0.5 THEN 'signal_only' WHEN lr >= 0.5 THEN 'tkg_only' ELSE 'neither' END AS verdict,
    signal_score, link_score, round(sr, 6) AS signal_rank, round(lr, 6) AS link_rank,
    round((CASE WHEN hl THEN 0.5 ELSE 1.0 END * sr + CASE WHEN hs THEN 0.5 ELSE 1.0 END * lr)
      / (CASE WHEN hl THEN 0.5 ELSE 1.0 END + CASE WHEN hs THEN 0.5 ELSE 1.0 END), 6) AS consensus FROM x)"""


def _verdicts(spark, d):
    a, b, _ = _parts(spark, d)
    return fusion.cross_examine(a, b)


@query("rnk_10_cross_examination", f"WITH {EXAMINE} SELECT * FROM verdicts")
def _(spark, d):
    return _verdicts(spark, d).withColumns({"signal_rank": r6("signal_rank"), "link_rank": r6("link_rank")})


@query("rnk_10_conflicts", f"WITH {EXAMINE} SELECT entity, verdict FROM verdicts WHERE verdict IN ('signal_only', 'tkg_only')")
def _(spark, d):
    return fusion.conflicts(_verdicts(spark, d)).select("entity", "verdict")


@query("agg_22_verdict_counts", f"WITH {EXAMINE} SELECT verdict, count(*) AS n FROM verdicts GROUP BY 1")
def _(spark, d):
    return fusion.verdict_counts(_verdicts(spark, d))


# Walk-forward windows over dated documents.
ORIGINS = """last AS (SELECT max(substr(time, 1, 7)) || '-01' AS m FROM mentions),
origins AS (SELECT f::INT AS fold, strftime(m::DATE + to_months(1 - (4 - f)::INT) - to_months(1), '%Y-%m') AS test_start,
    strftime(m::DATE + to_months(1 - (4 - f)::INT), '%Y-%m') AS test_end FROM last CROSS JOIN range(5) r(f))"""


@query("win_19_rolling_origins", f"WITH {MENTIONS}, {ORIGINS} SELECT fold, test_start, test_end FROM origins")
def _(spark, d):
    return backtest.rolling_origins(B.mentions(spark, d))


FOLDS = ORIGINS + """, folds AS (SELECT o.fold, CASE WHEN substr(m.time, 1, 7) >= o.test_start THEN 'test' ELSE 'train' END AS role, m.*
  FROM facts m JOIN origins o ON (substr(m.time, 1, 7) >= o.test_start AND substr(m.time, 1, 7) < o.test_end)
    OR substr(m.time, 1, 7) < strftime((o.test_start || '-01')::DATE - to_months(1), '%Y-%m'))"""


def _facts(spark, d):
    return B.mentions(spark, d).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("head"),
        F.lit("belongs_to").alias("relation"),
        F.col("entity").alias("tail"),
        "time",
    )


FACTS = MENTIONS + ", facts AS (SELECT 'd' || doc_id AS head, 'belongs_to' AS relation, entity AS tail, time FROM mentions)"


@query(
    "join_07_walk_forward",
    f"WITH {FACTS}, {FOLDS} SELECT fold, role, count(*) AS n, min(time) AS first_time, max(time) AS last_time FROM folds GROUP BY 1, 2",
)
def _(spark, d):
    facts = _facts(spark, d)
    folds = backtest.walk_forward(facts, backtest.rolling_origins(facts))
    return folds.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )


@query(
    "join_07_walk_forward_rolling",
    f"""WITH {FACTS}, {ORIGINS} SELECT o.fold, CASE WHEN substr(m.time, 1, 7) >= o.test_start THEN 'test' ELSE 'train' END AS role, m.head, m.tail, m.time
    FROM facts m JOIN origins o ON (substr(m.time, 1, 7) >= o.test_start AND substr(m.time, 1, 7) < o.test_end)
      OR (substr(m.time, 1, 7) < strftime((o.test_start || '-01')::DATE - to_months(1), '%Y-%m')
          AND substr(m.time, 1, 7) >= strftime((o.test_start || '-01')::DATE - to_months(6), '%Y-%m'))""",
)
def _(spark, d):
    facts = _facts(spark, d)
    folds = backtest.walk_forward(facts, backtest.rolling_origins(facts), mode="rolling", window=6)
    return folds.select("fold", "role", "head", "tail", "time")


@query(
    "agg_18_leak_check",
    f"""WITH {FACTS}, {FOLDS}, e AS (SELECT fold, role, head AS entity FROM folds UNION SELECT fold, role, tail FROM folds),
    pe AS (SELECT fold, entity, max((role = 'train')::INT) AS tr, max((role = 'test')::INT) AS te FROM e GROUP BY 1, 2),
    ents AS (SELECT fold, sum(te)::BIGINT AS test_entities, count(*) FILTER (WHERE te = 1 AND tr = 0) AS test_only_entities FROM pe GROUP BY 1),
    sp AS (SELECT fold, max(CASE WHEN role = 'train' THEN substr(time, 1, 7) END) AS max_train_month,
        min(CASE WHEN role = 'test' THEN substr(time, 1, 7) END) AS min_test_month,
        count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'test') AS n_test FROM folds GROUP BY 1)
    SELECT sp.*, test_entities, test_only_entities, coalesce(max_train_month >= min_test_month, false) AS violation
    FROM sp JOIN ents ON ents.fold = sp.fold""",
)
def _(spark, d):
    facts = _facts(spark, d)
    return backtest.leak_check(backtest.walk_forward(facts, backtest.rolling_origins(facts)))


@query(
    "set_04_new_test_entities",
    f"""WITH {FACTS}, {FOLDS} SELECT DISTINCT head AS entity, fold FROM folds WHERE role = 'test'
    EXCEPT SELECT DISTINCT head, fold FROM folds WHERE role = 'train'""",
)
def _(spark, d):
    facts = _facts(spark, d)
    folds = backtest.walk_forward(facts, backtest.rolling_origins(facts))
    pick = lambda r: folds.where(F.col("role") == r).select(F.col("head").alias("entity"), "fold").distinct()
    return pick("test").join(pick("train"), ["entity", "fold"], "left_anti")


@query(
    "agg_17_aggregate_folds",
    f"""WITH {FACTS}, {FOLDS}, m AS (SELECT fold, avg(length(tail)) AS a, CASE WHEN fold % 2 = 0 THEN count(*)::DOUBLE END AS b FROM folds GROUP BY 1)
    SELECT count(*) AS n_folds, round(avg(a), 6) AS a_mean, round(stddev_pop(a), 6) AS a_std, round(avg(b), 6) AS b_mean,
      round(stddev_pop(b), 6) AS b_std FROM m""",
)
def _(spark, d):
    facts = _facts(spark, d)
    folds = backtest.walk_forward(facts, backtest.rolling_origins(facts))
    per = folds.groupBy("fold").agg(
        F.avg(F.length("tail")).alias("a"),
        F.when(F.col("fold") % 2 == 0, F.count(F.lit(1)).cast("double")).alias("b"),
    )
    return metrics.aggregate_folds(per, ["a", "b"]).select("n_folds", r6("a_mean"), r6("a_std"), r6("b_mean"), r6("b_std"))


# Ranking backtest: every fold with its own history, in plain SQL.
BACKTEST = DENSE.replace("mentions AS", "RECURSIVE mentions AS", 1) + f""", {ORIGINS},
shape AS (SELECT o.fold, o.test_start, o.test_end, count(*) FILTER (WHERE b.bin < o.test_start) AS h,
    count(*) FILTER (WHERE b.bin >= o.test_start AND b.bin < o.test_end) AS m FROM origins o CROSS JOIN bins b GROUP BY 1, 2, 3),
cells AS (SELECT s.fold, s.h, s.m, d.entity, d.ord, d.x FROM dense d CROSS JOIN shape s WHERE s.h > 0 AND s.m > 0 AND d.bin < s.test_end),
hist AS (SELECT fold, entity, ord, h AS n, x,
    (x + 1) / (sum(x) OVER (PARTITION BY fold, ord) + (SELECT count(DISTINCT entity) FROM counts)) AS s FROM cells WHERE ord <= h),
walk AS (SELECT fold, entity, ord, n, x AS e3, x AS e6, s AS s3, s AS s6 FROM hist WHERE ord = 1
  UNION ALL
  SELECT h.fold, h.entity, h.ord, h.n, h.x * 0.5 + p.e3 * 0.5, h.x * (2.0 / 7.0) + p.e6 * (5.0 / 7.0),
    h.s * 0.5 + p.s3 * 0.5, h.s * (2.0 / 7.0) + p.s6 * (5.0 / 7.0)
  FROM walk p JOIN hist h ON h.fold = p.fold AND h.entity = p.entity AND h.ord = p.ord + 1),
steps AS (SELECT fold, entity, ord, n, x, ln(1 + x) - lag(ln(1 + x)) OVER (PARTITION BY fold, entity ORDER BY ord) AS g FROM hist),
feats AS (SELECT w.fold, w.entity, w.e3 AS ema_short, w.e3 - w.e6 AS macd, (w.s3 - w.s6) / (w.s6 + 1e-6) AS relative_growth,
    v.stability, v.persistence
  FROM walk w JOIN (SELECT fold, entity, -coalesce(stddev_samp(g), 0) AS stability,
      avg(CASE WHEN ord > n - 12 THEN CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END END) AS persistence FROM steps GROUP BY 1, 2) v
    ON v.fold = w.fold AND v.entity = w.entity WHERE w.ord = w.n),
long AS (SELECT fold, entity, f, v FROM feats UNPIVOT (v FOR f IN (ema_short, macd, relative_growth, stability, persistence))),
pos AS (SELECT *, row_number() OVER (PARTITION BY fold, f ORDER BY v) - 1 AS p, count(*) OVER (PARTITION BY fold, f) AS n FROM long),
st AS (SELECT fold, f, max(CASE WHEN p = n // 4 THEN v END) AS q1, max(CASE WHEN p = n // 2 THEN v END) AS med,
    max(CASE WHEN p = (n * 3) // 4 THEN v END) AS q3, min(v) AS lo, max(v) AS hi FROM pos GROUP BY 1, 2),
z AS (SELECT l.fold, l.entity, l.f, CASE WHEN q3 = q1 AND hi - lo <= 1e-9 * greatest(abs(lo), abs(hi)) THEN 0.5 WHEN q3 = q1 THEN (v - lo) / (hi - lo)
    ELSE 1 / (1 + exp(-greatest(-35, least(35, (v - med) / ((q3 - q1) / 1.34896))))) END AS z FROM long l JOIN st ON st.fold = l.fold AND st.f = l.f),
scores AS (SELECT fold, entity, sum(z * CASE f WHEN 'ema_short' THEN 0.25 WHEN 'macd' THEN 0.30 WHEN 'relative_growth' THEN 0.20 ELSE 0.125 END) AS score
  FROM z GROUP BY 1, 2),
ranked AS (SELECT fold, entity, row_number() OVER (PARTITION BY fold ORDER BY round(score, 12) DESC, entity) AS pos FROM scores QUALIFY pos <= 10),
cost AS (SELECT d.fold, d.entity, d.ord, d.n, d.x, r.rate, ln(d.n) AS tau,
    CASE WHEN r.rate > 0 THEN r.rate - d.x * ln(CASE WHEN r.rate > 0 THEN r.rate ELSE 1 END) ELSE 0 END AS k0,
    CASE WHEN r.rate > 0 THEN 2 * r.rate - d.x * ln(CASE WHEN r.rate > 0 THEN 2 * r.rate ELSE 1 END) ELSE 0 END AS k1
  FROM hist d JOIN (SELECT fold, entity, avg(x) AS rate FROM hist GROUP BY 1, 2) r ON r.fold = d.fold AND r.entity = d.entity),
vit AS (SELECT fold, entity, ord, n, rate, k0 AS c0, k1 AS c1, '0' AS p0, '1' AS p1 FROM cost WHERE ord = 1
  UNION ALL
  SELECT c.fold, c.entity, c.ord, c.n, c.rate, CASE WHEN v.c0 <= v.c1 + c.tau THEN v.c0 ELSE v.c1 + c.tau END + c.k0,
    CASE WHEN v.c0 + c.tau <= v.c1 THEN v.c0 + c.tau ELSE v.c1 END + c.k1,
    (CASE WHEN v.c0 <= v.c1 + c.tau THEN v.p0 ELSE v.p1 END) || '0', (CASE WHEN v.c0 + c.tau <= v.c1 THEN v.p0 ELSE v.p1 END) || '1'
  FROM vit v JOIN cost c ON c.fold = v.fold AND c.entity = v.entity AND c.ord = v.ord + 1),
bw AS (SELECT h.fold, h.entity, max(CASE WHEN v.rate > 0 AND substr(CASE WHEN v.c0 <= v.c1 THEN v.p0 ELSE v.p1 END, h.ord::INT, 1) = '1' THEN h.x ELSE 0 END) AS weight
  FROM hist h JOIN vit v ON v.fold = h.fold AND v.entity = h.entity AND v.ord = v.n GROUP BY 1, 2),
branked AS (SELECT fold, entity FROM bw QUALIFY row_number() OVER (PARTITION BY fold ORDER BY weight DESC, entity) <= 10),
fut AS (SELECT fold, entity, avg(CASE WHEN ord > h THEN x END) AS rel, avg(CASE WHEN ord <= h THEN x END) AS past FROM cells GROUP BY 1, 2),
truth AS (SELECT fold, entity FROM fut QUALIFY row_number() OVER (PARTITION BY fold ORDER BY rel - past DESC, entity) <= 10),
rel AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY rel DESC, entity) AS p FROM fut),
rho AS (SELECT fold, 1 - 6 * sum((a - b) ** 2) / (count(*)::DOUBLE * (count(*)::DOUBLE ** 2 - 1)) AS rho FROM (
    SELECT s.fold, row_number() OVER (PARTITION BY s.fold ORDER BY s.score DESC, s.entity) AS a, r.p AS b
    FROM scores s JOIN rel r ON r.fold = s.fold AND r.entity = s.entity) GROUP BY 1),
hit AS (SELECT r.fold, count(t.entity) / count(*)::DOUBLE AS p FROM ranked r LEFT JOIN truth t ON t.fold = r.fold AND t.entity = r.entity GROUP BY 1),
bhit AS (SELECT r.fold, count(t.entity) / count(*)::DOUBLE AS p FROM branked r LEFT JOIN truth t ON t.fold = r.fold AND t.entity = r.entity GROUP BY 1),
gain AS (SELECT r.fold, sum(CASE WHEN r.pos <= 3 THEN (2.0 ** f.rel - 1) / log2(r.pos + 1) END) AS d3,
    sum(CASE WHEN r.pos <= 5 THEN (2.0 ** f.rel - 1) / log2(r.pos + 1) END) AS d5,
    max(CASE WHEN r.pos = 1 THEN f.rel END) / avg(f.rel) AS lift FROM ranked r JOIN fut f ON f.fold = r.fold AND f.entity = r.entity GROUP BY 1),
ideal AS (SELECT fold, sum(CASE WHEN p <= 3 THEN (2.0 ** rel - 1) / log2(p + 1) END) AS i3, sum(CASE WHEN p <= 5 THEN (2.0 ** rel - 1) / log2(p + 1) END) AS i5
  FROM rel WHERE p <= 5 GROUP BY 1)
SELECT s.fold, s.test_start, round(hit.p, 6) AS p_at_k, round(hit.p, 6) AS r_at_k, round(d3 / i3, 6) AS ndcg_at_3, round(d5 / i5, 6) AS ndcg_at_5,
  round(rho, 6) AS spearman_rho, round(lift, 6) AS top1_lift, round(bhit.p, 6) AS burst_p_at_k, round(bhit.p, 6) AS burst_r_at_k,
  s.h AS n_hist_bins, s.m AS n_test_bins
FROM shape s JOIN hit ON hit.fold = s.fold JOIN bhit ON bhit.fold = s.fold JOIN gain ON gain.fold = s.fold JOIN ideal ON ideal.fold = s.fold
JOIN rho ON rho.fold = s.fold"""


@query("bt_01_ranking_backtest", "WITH " + BACKTEST)
def _(spark, d):
    out = backtest.backtest_ranking(counts(spark, d))
    return out.select(
        "fold", "test_start", *[r6(c) for c in backtest.RANK_METRICS], "n_hist_bins", "n_test_bins"
    )


BASELINES = MOMENTUM + """, g AS (SELECT entity, avg(CASE WHEN ord > n - 6 THEN x END) - avg(CASE WHEN ord <= n - 6 THEN x END) AS growth FROM dense GROUP BY 1),
truth AS (SELECT entity FROM g ORDER BY growth DESC, entity LIMIT 10), r AS (SELECT entity FROM momentum ORDER BY score DESC, entity LIMIT 10)
SELECT 'share' AS ranking, round(count(t.entity) / 10.0, 6)::DOUBLE AS precision_at_k, round(count(t.entity) / 10.0, 6)::DOUBLE AS recall_at_k
FROM r LEFT JOIN truth t ON t.entity = r.entity"""


@query("bt_07_share_baseline", "WITH " + BASELINES)
def _(spark, d):
    from risewatch.plans.predict import baselines

    return baselines(counts(spark, d), rankings=("share",)).select("ranking", r6("precision_at_k"), r6("recall_at_k"))




@query(
    "bt_07_burst_baseline",
    f"""WITH {_tuned(2.0, 1.0).replace('dense d JOIN (SELECT entity, avg(x)', 'hd d JOIN (SELECT entity, avg(x)').replace('rate FROM dense GROUP', 'rate FROM hd GROUP').replace('FROM dense d JOIN vit', 'FROM hd d JOIN vit').replace('cost AS (', 'hd AS (SELECT entity, ord, n - 6 AS n, x FROM dense WHERE ord <= n - 6), cost AS (', 1)},
    b AS (SELECT e.entity, coalesce(max(s.weight), 0) AS w FROM (SELECT DISTINCT entity FROM dense) e LEFT JOIN segs s ON s.entity = e.entity GROUP BY 1),
    g AS (SELECT entity, avg(CASE WHEN ord > n - 6 THEN x END) - avg(CASE WHEN ord <= n - 6 THEN x END) AS growth FROM dense GROUP BY 1),
    truth AS (SELECT entity FROM g ORDER BY growth DESC, entity LIMIT 10), r AS (SELECT entity FROM b ORDER BY w DESC, entity LIMIT 10)
    SELECT 'burst' AS ranking, round(count(t.entity) / 10.0, 6)::DOUBLE AS precision_at_k, round(count(t.entity) / 10.0, 6)::DOUBLE AS recall_at_k
    FROM r LEFT JOIN truth t ON t.entity = r.entity""",
)
def _(spark, d):
    from risewatch.plans.predict import baselines

    return baselines(counts(spark, d), rankings=("burst",)).select("ranking", r6("precision_at_k"), r6("recall_at_k"))
