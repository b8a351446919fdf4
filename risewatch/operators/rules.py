"""Temporal rules over dated edges: symmetry, implication, transitivity, and rule-based candidate scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risewatch.operators.core import small
from risewatch.session import durable

HUB_PATHS = 100_000  # two-hop paths through one node beyond which its paths are no longer listed


def edge_first(facts: DataFrame) -> DataFrame:
    """Earliest time per (head, relation, tail)."""
    ok = (F.col("head") != "") & (F.col("relation") != "") & (F.col("tail") != "") & (F.col("time") != "")
    return facts.where(ok).groupBy("head", "relation", "tail").agg(F.min("time").alias("time"))


def _confidence(support: Column, body: Column) -> Column:
    return F.when(body > 0, F.round(support / body, 4)).otherwise(0.0)


def _relation_pairs(edges: DataFrame) -> DataFrame:
    """Every ordered pair of the relations in use; the relation vocabulary is fixed and small."""
    rels = edges.agg(F.array_sort(F.collect_set("relation")).alias("r"))
    return rels.select(F.explode("r").alias("r1"), "r").select("r1", F.explode("r").alias("r2"))


def mine_symmetry(edges: DataFrame) -> DataFrame:
    """Share of the edges of a relation whose reverse edge exists."""
    back = edges.select(F.col("tail").alias("head"), "relation", F.col("head").alias("tail"), F.lit(1).alias("_rev"))
    per = edges.join(back, ["head", "relation", "tail"], "left").groupBy("relation").agg(
        F.count("_rev").alias("support"), F.count(F.lit(1)).alias("body")
    )
    return per.select(
        F.concat(F.lit("symmetry["), "relation", F.lit("]")).alias("label"),
        F.lit("symmetry").alias("kind"),
        F.col("relation").alias("r1"),
        F.lit(None).cast("string").alias("r2"),
        "support",
        _confidence(F.col("support"), F.col("body")).alias("confidence"),
        F.lit(1).alias("len"),
    )


def mine_implication(edges: DataFrame) -> DataFrame:
    """Share of the edges of r1 whose ends are also joined by r2."""
    body = edges.groupBy(F.col("relation").alias("r1")).agg(F.count(F.lit(1)).alias("body"))
    rels = F.array_sort(F.collect_set("relation"))  # at most the relation vocabulary per pair of ends
    both = (
        edges.groupBy("head", "tail").agg(rels.alias("r"))
        .where(F.size("r") > 1)
        .groupBy("r").agg(F.count(F.lit(1)).alias("c"))
        .select(F.explode("r").alias("r1"), "r", "c").select("r1", F.explode("r").alias("r2"), "c")
        .where("r1 <> r2").groupBy("r1", "r2").agg(F.sum("c").alias("support"))
    )
    return (
        _relation_pairs(edges)
        .where("r1 <> r2")
        .join(body, "r1")
        .join(both, ["r1", "r2"], "left")
        .select(
            F.concat(F.lit("implication["), "r1", F.lit("->"), "r2", F.lit("]")).alias("label"),
            F.lit("implication").alias("kind"),
            "r1",
            "r2",
            F.coalesce("support", F.lit(0)).alias("support"),
            _confidence(F.coalesce("support", F.lit(0)), F.col("body")).alias("confidence"),
            F.lit(1).alias("len"),
        )
    )


def _heavy(edges: DataFrame) -> DataFrame:
    """Middles with more than ``HUB_PATHS`` paths (in x out degree): ``y, heavy``, stored."""
    ins = edges.groupBy(F.col("tail").alias("y")).agg(F.count(F.lit(1)).alias("_i"))
    outs = edges.groupBy(F.col("head").alias("y")).agg(F.count(F.lit(1)).alias("_o"))
    return durable(ins.join(outs, "y").where(F.col("_i") * F.col("_o") > HUB_PATHS).select("y", F.lit(True).alias("heavy")))


def _ends(edges: DataFrame, a: str, r: str, b: str, t: str) -> DataFrame:
    return edges.select(*(F.col(c).alias(n) for c, n in zip(("head", "relation", "tail", "time"), (a, r, b, t))))


def _listed(edges: DataFrame) -> DataFrame:
    """``r1, r2, body, support`` from a list of all paths, where no middle is heavy.

    A path only matters through the earliest moment both of its edges exist.
    """
    paths = _ends(edges, "x", "r1", "y", "t1").join(_ends(edges, "y", "r2", "z", "t2"), "y").where("x <> z")
    bodies = paths.groupBy("r1", "r2", "x", "z").agg(F.min(F.greatest("t1", "t2")).alias("ready"))
    return (
        bodies.join(_ends(edges, "x", "r1", "z", "t3"), ["x", "r1", "z"], "left")
        .groupBy("r1", "r2")
        .agg(F.count(F.lit(1)).alias("body"), F.count_if(F.col("ready") < F.col("t3")).alias("support"))
    )


def _bodies(edges: DataFrame, heavy: DataFrame) -> DataFrame:
    """Number of distinct pairs (x, z), x != z, joined by r1 then r2: ``r1, r2, body``.

    Paths through light middles are listed; each middle has at most ``HUB_PATHS``. What an x reaches through heavy
    middles depends only on the set of them, so it is listed once for each distinct set (known by its size and two
    hashes), and every x with that set counts it. Light pairs that the heavy set reaches too are not counted twice.
    """
    heavy = small(heavy)
    mark = lambda df: durable(df.join(heavy, "y", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False))))
    first, second = mark(_ends(edges, "x", "r1", "y", "t1").drop("t1")), mark(_ends(edges, "y", "r2", "z", "t2").drop("t2"))
    light = first.where("not heavy").drop("heavy").join(second.where("not heavy").drop("heavy"), "y").where("x <> z").select("r1", "r2", "x", "z").distinct()
    sets = first.where("heavy").groupBy("x", "r1").agg(
        F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64(F.lit(1), "y")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(2), "y")).alias("s2")
    )
    sets = durable(sets)
    key = ["r1", "m", "s1", "s2"]
    kinds = sets.groupBy(*key).agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("users"))
    middles = durable(kinds.join(first.where("heavy").drop("heavy"), ["x", "r1"]).select(*key, "y"))
    reach = durable(second.where("heavy").drop("heavy").join(small(middles), "y").select(*key, "r2", "z").distinct())
    sizes = reach.groupBy(*key, "r2").agg(F.count(F.lit(1)).alias("n"))
    through = kinds.join(sizes, key).groupBy("r1", "r2").agg(F.sum(F.col("users") * F.col("n")).alias("n"))
    back = sets.withColumnRenamed("x", "z").join(reach, [*key, "z"]).groupBy("r1", "r2").agg((-F.count(F.lit(1))).alias("n"))
    both = light.join(sets, ["x", "r1"]).join(reach, [*key, "r2", "z"], "left_semi").select("r1", "r2", "x", "z")
    alone = light.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).unionByName(both.groupBy("r1", "r2").agg((-F.count(F.lit(1))).alias("n")))
    return through.unionByName(back).unionByName(alone).groupBy("r1", "r2").agg(F.sum("n").alias("body"))


def _closed(edges: DataFrame) -> DataFrame:
    """Triples ``r1, r2, x, z``: x -r1-> y -r2-> z, and later x -r1-> z, for some y.

    Each triangle is listed at its node of least degree, so a hub is never the middle of a listed pair and no node has
    more than the square root of twice the edges to be paired.
    """
    ends = edges.select(F.explode(F.array("head", "tail")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("deg"))
    known = edges.where("head <> tail")
    known = known.join(ends.toDF("head", "dh"), "head").join(ends.toDF("tail", "dt"), "tail")
    out = F.struct("dh", "head") < F.struct(F.col("dt").alias("dh"), F.col("tail").alias("head"))  # the head is the lesser end
    half = durable(known.select(F.when(out, F.col("head")).otherwise(F.col("tail")).alias("low"), F.when(out, F.col("tail")).otherwise(F.col("head")).alias("high"), out.alias("out"), "relation", "time"))
    side = lambda forward, *names: half.where(F.col("out") == forward).select("low", *(F.col(c).alias(n) for c, n in zip(("high", "relation", "time"), names)))
    third = lambda *names: _ends(edges, *names)
    later = (F.col("t1") < F.col("t3")) & (F.col("t2") < F.col("t3"))
    found = ["r1", "r2", "x", "z"]
    # least node x: both r1 edges leave it
    at_x = side(True, "y", "r1", "t1").join(side(True, "z", "r1", "t3"), ["low", "r1"]).where("y <> z and t1 < t3")
    at_x = at_x.join(third("y", "r2", "z", "t2"), ["y", "z"]).where(later).select("r1", "r2", F.col("low").alias("x"), "z")
    # least node y: one edge comes, one leaves
    at_y = side(False, "x", "r1", "t1").join(side(True, "z", "r2", "t2"), "low").where("x <> z")
    at_y = at_y.join(third("x", "r1", "z", "t3"), ["x", "r1", "z"]).where(later).select(*found)
    # least node z: both edges come
    at_z = side(False, "x", "r1", "t3").join(side(False, "y", "r2", "t2"), "low").where("x <> y and t2 < t3")
    at_z = at_z.join(third("x", "r1", "y", "t1"), ["x", "r1", "y"]).where(later).select("r1", "r2", "x", F.col("low").alias("z"))
    # y = x: an edge of x to itself, then r2, closed by r1
    loops = edges.where("head = tail").select(F.col("head").alias("x"), F.col("relation").alias("r1"), F.col("time").alias("t1"))
    at_loop = loops.join(third("x", "r1", "z", "t3"), ["x", "r1"]).where("x <> z").join(third("x", "r2", "z", "t2"), ["x", "z"]).where(later).select(*found)
    return at_x.unionByName(at_y).unionByName(at_z).unionByName(at_loop).distinct()


def mine_transitivity(edges: DataFrame) -> DataFrame:
    """Share of the (x, z) pairs linked by r1 then r2 that are closed by a later r1 edge."""
    edges = durable(edges)
    heavy = _heavy(edges)
    if heavy.isEmpty():
        per = _listed(edges)
    else:
        support = _closed(edges).groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("support"))
        per = _bodies(edges, heavy).join(support, ["r1", "r2"], "left")
    return (
        _relation_pairs(edges)
        .join(per, ["r1", "r2"], "left")
        .select(
            F.concat(F.lit("transitivity["), "r1", F.lit(","), "r2", F.lit("]")).alias("label"),
            F.lit("transitivity").alias("kind"),
            "r1",
            "r2",
            F.coalesce("support", F.lit(0)).alias("support"),
            _confidence(F.coalesce("support", F.lit(0)), F.coalesce("body", F.lit(0))).alias("confidence"),
            F.lit(2).alias("len"),
        )
    )


def mine_rules(facts: DataFrame, min_support: int = 3, min_confidence: float = 0.05, max_len: int = 3) -> DataFrame:
    edges = durable(edge_first(facts))
    every = mine_symmetry(edges).unionByName(mine_implication(edges)).unionByName(mine_transitivity(edges))
    return filter_rules(every, min_support, min_confidence, max_len)


def filter_rules(rules: DataFrame, min_support: int = 3, min_confidence: float = 0.05, max_len: int = 3) -> DataFrame:
    return rules.where(
        (F.col("support") >= min_support) & (F.col("confidence") >= min_confidence) & (F.col("len") <= max_len)
    )


def score_candidates(queries: DataFrame, edges: DataFrame, rules: DataFrame, strict_first_hop: bool = False) -> DataFrame:
    """Sum of rule confidences that lead from the query head to each candidate before the query time.

    ``queries`` has ``query, head, relation, time``. One hop scores ``symmetry[r]``, two hops
    ``transitivity[r, r2]``; the second edge must precede the query, the first one too when asked.
    Paths are counted per (query, candidate, rule) before confidences are attached.
    """
    conf = durable(rules.select("kind", "r1", "r2", "confidence"))
    first = queries.join(edges.withColumnRenamed("time", "t1").withColumnRenamed("tail", "y"), ["head", "relation"])
    one = (
        first.where("t1 < time")
        .groupBy("query", "relation", F.col("y").alias("candidate"))
        .agg(F.count(F.lit(1)).alias("paths"))
        .join(small(conf.where("kind = 'symmetry'").select(F.col("r1").alias("relation"), "confidence")), "relation")
    )
    start = first.where("t1 < time") if strict_first_hop else first
    hop = edges.select(F.col("head").alias("y"), F.col("relation").alias("r2"), F.col("tail").alias("z"), F.col("time").alias("t2"))
    two = (
        start.join(hop, "y")
        .where((F.col("t2") < F.col("time")) & (F.col("z") != F.col("head")))
        .groupBy("query", "relation", "r2", F.col("z").alias("candidate"))
        .agg(F.count(F.lit(1)).alias("paths"))
        .join(
            small(conf.where("kind = 'transitivity'").select(F.col("r1").alias("relation"), "r2", "confidence")),
            ["relation", "r2"],
        )
    )
    cols = ["query", "candidate", (F.col("paths") * F.col("confidence")).alias("part")]
    return one.select(*cols).unionByName(two.select(*cols)).groupBy("query", "candidate").agg(F.sum("part").alias("score"))
