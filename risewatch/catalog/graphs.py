"""Queries over the concept graph: projection, splits, rules, link scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from risewatch import bindings as B
from risewatch.catalog.registry import DIRECTED, MENTIONS, query
from risewatch.catalog.series import MOMENTUM, counts, r6
from risewatch.operators import forecast as FC
from risewatch.operators import graph as G
from risewatch.operators import links, rules
from risewatch.operators.fusion import forecast_signal, fuse
from risewatch.operators.series import share_momentum
from risewatch.plans import backtest
from risewatch.plans.collaborate import blended_link_scores, collaborate
from risewatch.plans.predict import baselines
from risewatch.session import durable

DOCS = MENTIONS + ", docs AS (SELECT 'doc:' || doc_id AS doc, entity AS concept, min(time) AS time FROM mentions GROUP BY 1, 2)"
PAIRS = DOCS + """, pairs AS (SELECT x.concept AS a, y.concept AS b, count(*) AS n FROM docs x JOIN docs y ON x.doc = y.doc AND x.concept < y.concept
  GROUP BY 1, 2 HAVING count(*) >= 2)"""


FACTS = PAIRS + """, once AS (SELECT x.concept AS a, y.concept AS b, x.time FROM docs x JOIN docs y ON x.doc = y.doc JOIN pairs k ON k.a = x.concept AND k.b = y.concept),
facts AS (SELECT a AS head, 'relates_to' AS relation, b AS tail, time FROM once UNION ALL SELECT b, 'relates_to', a, time FROM once)"""


def docs(spark, d):
    return G.doc_concepts(B.concept_triples(spark, d))


def facts(spark, d, hub_size=G.HUB_SIZE):
    return G.project_cooccurrence(B.concept_triples(spark, d), hub_size=hub_size, counted=True)


@query("join_06_pair_support", f"WITH {PAIRS} SELECT a, b, n FROM pairs")
def _(spark, d):
    return G.pair_support(docs(spark, d))


@query("join_06_pair_support_hubs", f"WITH {PAIRS} SELECT a, b, n FROM pairs")
def _(spark, d):
    return G.pair_support(docs(spark, d), hub_size=5)


@query("grf_01_cooccurrence_facts", f"WITH {FACTS} SELECT head, relation, tail, time, count(*) AS n FROM facts GROUP BY ALL")
def _(spark, d):
    return facts(spark, d)


@query("grf_01_cooccurrence_facts_hubs", f"WITH {FACTS} SELECT head, relation, tail, time, count(*) AS n FROM facts GROUP BY ALL")
def _(spark, d):
    return facts(spark, d, hub_size=4)


@query(
    "grf_02_directed_facts",
    f"""WITH {DIRECTED} SELECT DISTINCT head, relation, tail, time FROM directed
    QUALIFY count(*) OVER (PARTITION BY head, relation, tail) >= 20""",
)
def _(spark, d):
    return G.directed_facts(B.directed(spark, d), min_support=20)


SPLIT = DIRECTED + """, days AS (SELECT time, count(*) AS c FROM directed GROUP BY 1),
cum AS (SELECT time, coalesce(sum(c) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(c) OVER () AS n FROM days),
cuts AS (SELECT *, greatest(1, floor(n * 0.7::DOUBLE)) AS e1 FROM cum),
roles AS (SELECT time, CASE WHEN before < e1 THEN 'train' WHEN before < greatest(e1 + 1, floor(n * (0.7::DOUBLE + 0.1::DOUBLE))) THEN 'val' ELSE 'test' END AS role FROM cuts),
split AS (SELECT d.*, r.role FROM directed d JOIN roles r ON r.time = d.time)"""


@query("grf_03_temporal_split", f"WITH {SPLIT} SELECT role, count(*) AS n, min(time) AS first_time, max(time) AS last_time FROM split GROUP BY 1")
def _(spark, d):
    s = G.temporal_split(B.directed(spark, d).select("head", "relation", "tail", "time"))
    return s.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))


@query(
    "grf_04_ordered_split",
    f"""WITH {DIRECTED}, r AS (SELECT *, row_number() OVER (ORDER BY time, head, relation, tail) AS rn, count(*) OVER () AS n FROM directed)
    SELECT head, relation, tail, time, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS role FROM r""",
)
def _(spark, d):
    return G.ordered_split(B.directed(spark, d).select("head", "relation", "tail", "time"))


@query(
    "grf_04_hash_split",
    f"""WITH {DIRECTED}, s AS (SELECT *, ('0x' || substr(sha1(head || '|' || relation || '|' || tail || '|' || time || '|42'), 1, 8))::BIGINT % 10000 AS slot FROM directed)
    SELECT head, relation, tail, time, CASE WHEN slot < 8000 THEN 'train' ELSE 'test' END AS role FROM s""",
)
def _(spark, d):
    return G.hash_split(B.directed(spark, d).select("head", "relation", "tail", "time"))


@query(
    "grf_05_entity_ids",
    f"""WITH {FACTS} SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS entity_id FROM (SELECT DISTINCT head AS entity FROM facts)""",
)
def _(spark, d):
    return G.encode_entities(facts(spark, d))


@query(
    "grf_05_relation_ids",
    f"WITH {DIRECTED} SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS relation_id FROM (SELECT DISTINCT relation FROM directed)",
)
def _(spark, d):
    return G.encode_relations(B.directed(spark, d))


EDGES = DIRECTED + ", edges AS (SELECT head, relation, tail, min(time) AS time FROM directed GROUP BY 1, 2, 3)"
SYMMETRY = """SELECT 'symmetry[' || e.relation || ']' AS label, count(r.head) AS support, round(count(r.head) / count(*)::DOUBLE, 4) AS confidence, 1 AS len
  FROM edges e LEFT JOIN edges r ON r.head = e.tail AND r.tail = e.head AND r.relation = e.relation GROUP BY e.relation"""
IMPLICATION = """SELECT 'implication[' || e.relation || '->' || q.relation || ']' AS label, count(r.head) AS support, round(count(r.head) / count(*)::DOUBLE, 4) AS confidence, 1 AS len
  FROM edges e CROSS JOIN (SELECT DISTINCT relation FROM edges) q LEFT JOIN edges r ON r.head = e.head AND r.tail = e.tail AND r.relation = q.relation
  WHERE q.relation <> e.relation GROUP BY e.relation, q.relation"""
TRANSITIVITY = """SELECT 'transitivity[' || r1 || ',' || r2 || ']' AS label, sum(ok)::BIGINT AS support, round(sum(ok) / count(*)::DOUBLE, 4) AS confidence, 2 AS len
  FROM (SELECT a.relation AS r1, b.relation AS r2, a.head AS x, b.tail AS z, max(CASE WHEN h.time > a.time AND h.time > b.time THEN 1 ELSE 0 END) AS ok
    FROM edges a JOIN edges b ON b.head = a.tail LEFT JOIN edges h ON h.head = a.head AND h.tail = b.tail AND h.relation = a.relation
    WHERE a.head <> b.tail GROUP BY 1, 2, 3, 4) GROUP BY r1, r2"""
RULES = EDGES + f", rules AS ({SYMMETRY} UNION ALL {IMPLICATION} UNION ALL {TRANSITIVITY})"


def edges(spark, d):
    return durable(rules.edge_first(B.directed(spark, d)))


COLS = ["label", "support", "confidence", "len"]


@query("grf_07_edge_first", f"WITH {EDGES} SELECT head, relation, tail, time FROM edges")
def _(spark, d):
    return rules.edge_first(B.directed(spark, d))


@query("grf_08_symmetry_rules", f"WITH {EDGES} {SYMMETRY}")
def _(spark, d):
    return rules.mine_symmetry(edges(spark, d)).select(*COLS)


@query("grf_09_implication_rules", f"WITH {EDGES} {IMPLICATION}")
def _(spark, d):
    return rules.mine_implication(edges(spark, d)).select(*COLS)


@query("grf_10_transitivity_rules", f"WITH {EDGES} {TRANSITIVITY}")
def _(spark, d):
    return rules.mine_transitivity(edges(spark, d)).select(*COLS)


@query("grf_11_filtered_rules", f"WITH {RULES} SELECT * FROM rules WHERE support >= 3 AND confidence >= 0.05 AND len <= 3")
def _(spark, d):
    e = edges(spark, d)
    every = rules.mine_symmetry(e).unionByName(rules.mine_implication(e)).unionByName(rules.mine_transitivity(e))
    return rules.filter_rules(every).select(*COLS)


@query(
    "grf_11_rule_scores",
    f"""WITH {RULES}, q AS (SELECT relation || '|' || head AS query, head, relation, '1998-01-01' AS time FROM (SELECT DISTINCT head, relation FROM edges)),
    one AS (SELECT q.query, e.tail AS candidate, r.confidence AS c FROM q JOIN edges e ON e.head = q.head AND e.relation = q.relation AND e.time < q.time
      JOIN rules r ON r.label = 'symmetry[' || q.relation || ']'),
    two AS (SELECT q.query, f.tail AS candidate, r.confidence AS c FROM q JOIN edges e ON e.head = q.head AND e.relation = q.relation
      JOIN edges f ON f.head = e.tail AND f.time < q.time AND f.tail <> q.head JOIN rules r ON r.label = 'transitivity[' || q.relation || ',' || f.relation || ']')
    SELECT query, candidate, round(sum(c), 6) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2""",
)
def _(spark, d):
    e = edges(spark, d)
    every = durable(rules.mine_symmetry(e).unionByName(rules.mine_transitivity(e)))
    q = e.select("head", "relation").distinct().select(
        F.concat_ws("|", "relation", "head").alias("query"), "head", "relation", F.lit("1998-01-01").alias("time")
    )
    return rules.score_candidates(q, e, every).withColumn("score", r6("score"))


# Copy history on directed edges, first 70 % of time against the last 20 %.
HIST = SPLIT + """, hist AS (SELECT head, relation, tail, count(*) AS freq FROM split WHERE role = 'train' GROUP BY 1, 2, 3)"""


def parts(spark, d):
    """Directed edges split by time; test keeps only part of the train vocabulary in reach."""
    s = durable(G.temporal_split(B.directed(spark, d).select("head", "relation", "tail", "time")))
    return s.where("role = 'train'").drop("role"), s.where("role = 'test'").drop("role")


@query(
    "grf_12_copy_history",
    f"WITH {HIST} SELECT head, relation, tail, freq, round(freq / sum(freq) OVER (PARTITION BY head, relation), 6) AS share FROM hist",
)
def _(spark, d):
    train, _ = parts(spark, d)
    return links.copy_history(train).withColumn("share", r6("share"))


@query(
    "grf_13_copy_score",
    f"""WITH {HIST} SELECT t.head, t.relation, t.tail, t.time, coalesce(h.freq, 0)::DOUBLE AS score FROM split t
    LEFT JOIN hist h ON h.head = t.head AND h.relation = t.relation AND h.tail = t.tail WHERE t.role = 'test'""",
)
def _(spark, d):
    train, test = parts(spark, d)
    return links.copy_score(test, links.copy_history(train)).select("head", "relation", "tail", "time", "score")


@query("grf_14_known_tails", f"WITH {SPLIT} SELECT DISTINCT head, relation, tail FROM split WHERE role <> 'val'")
def _(spark, d):
    train, test = parts(spark, d)
    return links.known_tails(train.unionByName(test))


@query(
    "flt_05_transductive",
    f"""WITH {SPLIT}, tr AS (SELECT * FROM split WHERE role = 'train' AND head < 'M') SELECT head, relation, tail, time FROM split s WHERE role = 'test'
      AND head IN (SELECT head FROM tr UNION SELECT tail FROM tr) AND tail IN (SELECT head FROM tr UNION SELECT tail FROM tr) AND relation IN (SELECT relation FROM tr)""",
)
def _(spark, d):
    train, test = parts(spark, d)
    return G.transductive(test, train.where("head < 'M'"))


# General filtered rank: known tails are only the test tails, so history tails compete.
RANKS = HIST + """, ents AS (SELECT head AS e FROM split WHERE role = 'train' UNION SELECT tail FROM split WHERE role = 'train'),
q AS (SELECT head, relation, tail, count(*) AS times FROM split WHERE role = 'test' AND head IN (FROM ents) AND tail IN (FROM ents)
  AND relation IN (SELECT relation FROM hist) GROUP BY 1, 2, 3),
kn AS (SELECT DISTINCT head, relation, tail FROM {known}),
cand AS (SELECT q.head, q.relation, q.tail, q.times, e.e AS x, coalesce(h.freq, 0)::DOUBLE AS sx, coalesce(o.freq, 0)::DOUBLE AS so
  FROM q CROSS JOIN ents e LEFT JOIN hist h ON h.head = q.head AND h.relation = q.relation AND h.tail = e.e
  LEFT JOIN hist o ON o.head = q.head AND o.relation = q.relation AND o.tail = q.tail
  LEFT JOIN kn k ON k.head = q.head AND k.relation = q.relation AND k.tail = e.e WHERE k.head IS NULL OR e.e = q.tail),
ranks AS (SELECT head, relation, tail, times, count(*) FILTER (WHERE sx > so) + 1 + (count(*) FILTER (WHERE sx = so) - 1) / 2.0 AS rank FROM cand GROUP BY 1, 2, 3, 4)"""


@query("grf_15_filtered_rank", f"WITH {RANKS.replace('{known}', "(SELECT * FROM split WHERE role = 'test')")} SELECT head, relation, tail, times, rank FROM ranks")
def _(spark, d):
    train, test = parts(spark, d)
    hist = links.copy_history(train).withColumn("score", F.col("freq").cast("double"))
    q = links.known_queries(test, train)
    return links.filtered_rank(q, hist, links.known_tails(test), links.train_entities(train)).select(
        "head", "relation", "tail", "times", "rank"
    )


@query(
    "grf_16_copy_only_metrics",
    f"""WITH {RANKS.replace('{known}', "(SELECT * FROM split WHERE role <> 'val')")}
    SELECT round(sum(times / rank) / sum(times), 6) AS mrr, round(sum(times) FILTER (WHERE rank <= 1) / sum(times), 6) AS hits_at_1,
      round(sum(times) FILTER (WHERE rank <= 3) / sum(times), 6) AS hits_at_3, round(sum(times) FILTER (WHERE rank <= 10) / sum(times), 6) AS hits_at_10,
      sum(times)::BIGINT AS n_queries FROM ranks""",
)
def _(spark, d):
    train, test = parts(spark, d)
    return links.evaluate_copy_only(train, test).select(*[r6(c) for c in ("mrr", "hits_at_1", "hits_at_3", "hits_at_10")], "n_queries")


@query(
    "grf_18_future_link_scores",
    f"""WITH {HIST}, ents AS (SELECT head AS e FROM split WHERE role = 'train' UNION SELECT tail FROM split WHERE role = 'train'),
    heads AS (SELECT DISTINCT head FROM split WHERE role = 'test' AND head IN (FROM ents)),
    sh AS (SELECT head, tail, freq / sum(freq) OVER (PARTITION BY head, relation) AS s FROM hist WHERE relation = 'uses')
    SELECT e AS entity, round(coalesce((SELECT sum(s) FROM sh WHERE sh.tail = e AND sh.head IN (FROM heads)), 0) / (SELECT count(*) FROM heads), 6) AS score FROM ents""",
)
def _(spark, d):
    train, test = parts(spark, d)
    return links.future_link_scores(links.copy_history(train), test, train, "uses").withColumn("score", r6("score"))


LINK_BT = MENTIONS + """, facts AS (SELECT head, relation, tail, time FROM directed),
last AS (SELECT max(substr(time, 1, 7)) || '-01' AS m FROM facts),
origins AS (SELECT f::INT AS fold, strftime(m::DATE + to_months(1 - (4 - f)::INT) - to_months(1), '%Y-%m') AS test_start,
    strftime(m::DATE + to_months(1 - (4 - f)::INT), '%Y-%m') AS test_end FROM last CROSS JOIN range(5) r(f)),
folds AS (SELECT o.fold, CASE WHEN substr(m.time, 1, 7) >= o.test_start THEN 'test' ELSE 'train' END AS role, m.*
  FROM facts m JOIN origins o ON (substr(m.time, 1, 7) >= o.test_start AND substr(m.time, 1, 7) < o.test_end)
    OR substr(m.time, 1, 7) < strftime((o.test_start || '-01')::DATE - to_months(1), '%Y-%m')),
hist AS (SELECT fold, head, relation, tail, count(*) AS freq FROM folds WHERE role = 'train' GROUP BY 1, 2, 3, 4),
ents AS (SELECT fold, head AS e FROM hist UNION SELECT fold, tail FROM hist), ne AS (SELECT fold, count(*) AS n FROM ents GROUP BY 1),
kn AS (SELECT DISTINCT k.fold, k.head, k.relation, k.tail FROM folds k JOIN ents e ON e.fold = k.fold AND e.e = k.tail),
kc AS (SELECT fold, head, relation, count(*) AS k FROM kn GROUP BY 1, 2, 3),
ranks AS (SELECT t.fold, CASE WHEN h.head IS NOT NULL THEN 1 ELSE 1 + (ne.n - (kc.k - 1) - 1) / 2.0 END AS rank
  FROM folds t JOIN ents a ON a.fold = t.fold AND a.e = t.head JOIN ents b ON b.fold = t.fold AND b.e = t.tail JOIN ne ON ne.fold = t.fold
  JOIN kc ON kc.fold = t.fold AND kc.head = t.head AND kc.relation = t.relation
  LEFT JOIN hist h ON h.fold = t.fold AND h.head = t.head AND h.relation = t.relation AND h.tail = t.tail WHERE t.role = 'test'),
sizes AS (SELECT fold, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'test') AS n_test,
    max(substr(time, 1, 7)) FILTER (WHERE role = 'train') AS train_end, min(substr(time, 1, 7)) FILTER (WHERE role = 'test') AS test_start,
    max(substr(time, 1, 7)) FILTER (WHERE role = 'test') AS test_end FROM folds GROUP BY 1)
SELECT s.*, round(avg(1 / rank), 6) AS mrr, round(avg((rank <= 1)::INT), 6) AS hits_at_1, round(avg((rank <= 3)::INT), 6) AS hits_at_3,
  round(avg((rank <= 10)::INT), 6) AS hits_at_10 FROM sizes s JOIN ranks r ON r.fold = s.fold WHERE n_train >= 200 AND n_test > 0 GROUP BY ALL"""


@query("bt_02_link_backtest", "WITH " + DIRECTED + ", " + LINK_BT)
def _(spark, d):
    f = durable(B.directed(spark, d).select("head", "relation", "tail", "time"))
    out = backtest.backtest_links(f)
    return out.select(
        "fold", "n_train", "n_test", "train_end", "test_start", "test_end",
        *[r6(c) for c in ("mrr", "hits_at_1", "hits_at_3", "hits_at_10")],
    )


# Momentum against link history on the co-occurrence graph.
LINK_VIEW = FACTS.replace("mentions AS", "RECURSIVE mentions AS", 1)
MOMENTUM_VIEW = MOMENTUM[MOMENTUM.index("counts AS"):]
COLLAB = LINK_VIEW + ", " + MOMENTUM_VIEW + """,
fdays AS (SELECT time, count(*) AS c FROM facts GROUP BY 1),
fcum AS (SELECT time, coalesce(sum(c) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(c) OVER () AS fn FROM fdays),
froles AS (SELECT time, CASE WHEN before < greatest(1, floor(fn * 0.7::DOUBLE)) THEN 'train'
  WHEN before < greatest(greatest(1, floor(fn * 0.7::DOUBLE)) + 1, floor(fn * (0.7::DOUBLE + 0.1::DOUBLE))) THEN 'val' ELSE 'test' END AS role FROM fcum),
fs AS (SELECT f.*, r.role FROM facts f JOIN froles r ON r.time = f.time),
past AS (SELECT DISTINCT head AS e FROM fs WHERE role <> 'test'),
sh AS (SELECT head, tail, count(*) / sum(count(*)) OVER (PARTITION BY head) AS s FROM fs WHERE role = 'train' GROUP BY 1, 2),
qh AS (SELECT DISTINCT head FROM fs WHERE role = 'test' AND head IN (FROM past)),
link AS (SELECT e AS entity, coalesce((SELECT sum(s) FROM sh WHERE sh.tail = e AND sh.head IN (FROM qh)), 0) / (SELECT count(*) FROM qh) AS score FROM past),
sr AS (SELECT entity, score, (count(*) OVER () - row_number() OVER (ORDER BY score DESC, entity)) / (count(*) OVER () - 1)::DOUBLE AS z FROM momentum),
lr AS (SELECT entity, score, (count(*) OVER () - row_number() OVER (ORDER BY score DESC, entity)) / (count(*) OVER () - 1)::DOUBLE AS z FROM link)
SELECT coalesce(a.entity, b.entity) AS entity, CASE WHEN coalesce(a.z, 0) >= 0.5 AND coalesce(b.z, 0) >= 0.5 THEN 'agree' WHEN coalesce(a.z, 0) >= 0.5 THEN 'signal_only'
    WHEN coalesce(b.z, 0) >= 0.5 THEN 'tkg_only' ELSE 'neither' END AS verdict, round(a.score, 6) AS signal_score, round(b.score, 6) AS link_score
FROM sr a FULL JOIN lr b ON b.entity = a.entity"""


@query("rnk_10_momentum_against_links", f"WITH {COLLAB}")
def _(spark, d):
    out = collaborate(counts(spark, d), durable(facts(spark, d)))
    return out.select("entity", "verdict", r6("signal_score"), r6("link_score"))


# Fitted factors are beyond SQL: tests/test_blended.py holds the blended queries against plain versions.
@query("bt_02_blended_links")
def _(spark, d):
    days = B.directed(spark, d).groupBy("head", "relation", "tail", "time").agg(F.count(F.lit(1)).alias("n"))
    return backtest.backtest_blended_links(durable(days))


@query("grf_18_blended_link_scores")
def _(spark, d):
    return blended_link_scores(durable(facts(spark, d)))


def fusion_parts(spark, d):
    """Momentum, blended link scores and the forecast signal of the concepts."""
    c = counts(spark, d)
    return c, durable(blended_link_scores(durable(facts(spark, d)))), durable(forecast_signal(FC.forecast(c)))


@query("rnk_08_blended_fusion")
def _(spark, d):
    c, tkg, signal = fusion_parts(spark, d)
    return fuse(share_momentum(c, holdout=6), tkg, signal, k=10).select("entity", r6("score"), r6("burst"), r6("tkg"), r6("forecast"), "pos")


@query("bt_07_fusion_baseline")
def _(spark, d):
    c, tkg, signal = fusion_parts(spark, d)
    return baselines(c, rankings=("fusion",), tkg=tkg, forecast=signal).select("ranking", r6("precision_at_k"), r6("recall_at_k"))
