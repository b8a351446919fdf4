"""Entity resolution: DOI anchors, exact names, fuzzy names, hashed ids; then triple rewriting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risewatch.functions.text import blank_to_null, fallback_id, normalize_name
from risewatch.operators.core import small, spread
from risewatch.schemas import MATCH_TARGET
from risewatch.session import durable

ANCHOR_TYPES = ("Concept", "Institution", "Author")


def normalize_doi(c: Column) -> Column:
    return blank_to_null(F.rtrim(F.lower(F.trim(c)), F.lit(".")))


def align_doi(nodes: DataFrame, anchor_sources: tuple[str, ...] = ("openalex",)) -> DataFrame:
    """Papers sharing a DOI with a paper of an anchor source take that paper's entity id."""
    doi = F.when(F.col("type") == "Paper", normalize_doi(F.col("doi")))
    keyed = nodes.withColumn("_doi", doi)
    anchors = (
        keyed.where(F.col("_doi").isNotNull() & F.col("source").isin(*anchor_sources) & F.col("entity_id").isNotNull())
        .groupBy("_doi")
        .agg(F.min_by("entity_id", "id").alias("_anchor"))
    )
    # only nodes that an anchor may rename are joined; a null DOI would be one hot key
    asks = F.col("_doi").isNotNull() & F.coalesce(~F.col("source").isin(*anchor_sources), F.lit(False))
    renamed = keyed.where(asks).join(anchors, "_doi", "left").withColumn("entity_id", F.coalesce("_anchor", "entity_id"))
    return keyed.where(~asks).select(*nodes.columns).unionByName(renamed.select(*nodes.columns))


def anchor_index(nodes: DataFrame) -> DataFrame:
    """First anchored node per type and normalised name."""
    return (
        nodes.where(
            F.col("entity_id").isNotNull() & F.col("type").isin(*ANCHOR_TYPES) & (F.col("name") != "")
        )
        .groupBy("type", normalize_name(F.col("name")).alias("norm"))
        .agg(F.min_by("entity_id", "id").alias("anchor_entity"), F.min("id").alias("anchor_id"))
    )


def _target(c: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in MATCH_TARGET.items() for x in kv])
    return F.try_element_at(pairs, c)


def unresolved_names(nodes: DataFrame) -> DataFrame:
    """Distinct (target type, normalised name) of nodes that still lack an entity id."""
    return (
        nodes.where(F.col("entity_id").isNull() & (F.col("name") != ""))
        .select(_target(F.col("type")).alias("type"), normalize_name(F.col("name")).alias("norm"))
        .where(F.col("type").isNotNull())
        .distinct()
    )


def align_exact(names: DataFrame, anchors: DataFrame) -> DataFrame:
    """Names equal to an anchor of the same type."""
    return names.join(anchors, ["type", "norm"]).withColumn("score", F.lit(1.0))


@F.pandas_udf(T.DoubleType())
def indel_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``2 * LCS / (len(a) + len(b))`` with a bit-parallel longest common subsequence."""
    out = np.empty(len(a))
    for i, (s, t) in enumerate(zip(a, b)):
        if s is None or t is None:
            out[i] = np.nan
            continue
        if not s and not t:
            out[i] = 1.0
            continue
        where: dict[str, int] = {}
        for p, ch in enumerate(s):
            where[ch] = where.get(ch, 0) | (1 << p)
        full = (1 << len(s)) - 1
        row = full
        for ch in t:
            u = row & where.get(ch, 0)
            row = ((row + u) | (row - u)) & full
        out[i] = 2.0 * (len(s) - row.bit_count()) / (len(s) + len(t))
    return pd.Series(out)


#: A piece of an anchor is hot when more anchors of its type and length have it at its place; so many share a task.
HOT_PIECE = 1000


def fuzzy_pairs(names: DataFrame, anchors: DataFrame, threshold: float = 0.90) -> DataFrame:
    """All (name, anchor) pairs with similarity at or above the threshold, found without a theta join.

    A pair at similarity ``t`` needs at most ``k = floor((1 - t)(la + lb))`` insertions and deletions, and its
    lengths differ by at most the factor ``t / (2 - t)``. Cutting the anchor into ``k + 2`` pieces leaves two of them
    untouched, found in the name at an offset of at most ``k``; so the most frequent piece of an anchor need not be
    entered (an anchor too short for that is cut into ``k + 1`` and entered whole). That is an equi-join on
    (type, anchor length, piece number, piece), and it loses no pair. Pieces that are still hot are split over tasks,
    and pairs are held to the edit distance before they are shuffled.
    """
    t = threshold
    eps = 1e-9

    def budget(length: Column) -> Column:
        longest = F.floor(length * ((2 - t) / t) + eps)
        return F.floor((1 - t) * (length + longest) + eps).cast("int")

    def parts(length: Column) -> Column:
        return budget(length) + F.when(budget(length) + 2 <= length, 2).otherwise(1)

    def piece_start(length: Column, i: Column) -> Column:
        return F.floor(length * i / parts(length)).cast("int")

    a = anchors.select("type", F.col("norm").alias("anchor_norm"), "anchor_entity", "anchor_id").where(
        F.length("anchor_norm") > 0
    )
    la = F.length("anchor_norm")
    pieces = F.transform(
        F.sequence(F.lit(0), parts(la) - 1),
        lambda i: F.struct(
            i.alias("piece"), F.substr(F.col("anchor_norm"), piece_start(la, i) + 1, piece_start(la, i + 1) - piece_start(la, i)).alias("text")
        ),
    )
    key = ["type", "alen", "piece", "text"]
    cut = durable(a.select("*", la.alias("alen"), F.explode(pieces).alias("p")).select(*a.columns, "alen", "p.piece", "p.text"))
    # at most one piece in HOT_PIECE is hot
    hot = small(durable(cut.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_PIECE)))
    seen = cut.join(hot, key, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    most = F.max_by("piece", F.struct("_n", -F.length("text"), -F.col("piece"))).over(W.partitionBy("type", "anchor_norm", "anchor_entity", "anchor_id"))
    entered = seen.withColumn("_most", most).where((F.col("piece") != F.col("_most")) | (parts(F.col("alen")) == budget(F.col("alen")) + 1))
    tasks = lambda n: F.greatest(F.lit(1), F.ceil(n / HOT_PIECE)).cast("int")
    left = entered.withColumn("_task", F.pmod(F.xxhash64("anchor_norm"), tasks(F.col("_n"))).cast("int")).drop("_n", "_most")
    ln = F.length("norm")
    lengths = F.sequence(F.ceil(ln * (t / (2 - t)) - eps).cast("int"), F.floor(ln * ((2 - t) / t) + eps).cast("int"))
    probe = (
        names.where(ln > 0)
        .select("type", "norm", F.explode(lengths).alias("alen"))
        .where("alen > 0")
        .withColumn("k", budget(F.col("alen")))
        .select("type", "norm", "alen", "k", F.explode(F.sequence(F.lit(0), parts(F.col("alen")) - 1)).alias("piece"))
        .withColumn("at", piece_start(F.col("alen"), F.col("piece")))
        .withColumn("size", piece_start(F.col("alen"), F.col("piece") + 1) - F.col("at"))
        .withColumn("lo", F.greatest(F.lit(0), F.col("at") - F.col("k")))
        .withColumn("hi", F.least(ln - F.col("size"), F.col("at") + F.col("k")))
        .where("lo <= hi")
        .select(
            "type",
            "norm",
            "alen",
            "piece",
            F.explode(
                F.array_distinct(
                    F.transform(F.sequence("lo", "hi"), lambda s: F.substr(F.col("norm"), s + 1, F.col("size")))
                )
            ).alias("text"),
        )
        .join(hot, key, "left")
        .withColumn("_task", F.explode(F.sequence(F.lit(0), tasks(F.coalesce("_n", F.lit(0))) - 1)))
        .drop("_n")
    )
    room = F.floor((1 - t) * (F.length("norm") + F.length("anchor_norm")) + eps).cast("int")
    near = (
        probe.join(left, [*key, "_task"])
        .where(F.levenshtein("norm", "anchor_norm") <= room)  # edits never exceed insertions + deletions
        .groupBy("type", "norm", "anchor_norm")
        .agg(F.min("anchor_entity").alias("anchor_entity"), F.min("anchor_id").alias("anchor_id"))
    )
    return near.withColumn("score", indel_similarity(F.col("norm"), F.col("anchor_norm"))).where(F.col("score") >= t)


def align_fuzzy(names: DataFrame, anchors: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Best anchor per name at or above the threshold; ties by anchor name."""
    pick = F.min_by(
        F.struct("anchor_norm", "anchor_entity", "anchor_id", "score"), F.struct((-F.col("score")).alias("s"), "anchor_norm")
    )
    best = fuzzy_pairs(names, anchors, threshold).groupBy("type", "norm").agg(pick.alias("b"))
    return best.select("type", "norm", "b.anchor_entity", "b.anchor_id", "b.score")


def resolve_names(nodes: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Anchor of every unresolved name: exact first, fuzzy for the rest."""
    anchors = durable(anchor_index(nodes))
    names = durable(unresolved_names(nodes))
    exact = align_exact(names, anchors)
    rest = names.join(anchors, ["type", "norm"], "left_anti")
    cols = ["type", "norm", "anchor_entity", "anchor_id", "score"]
    return exact.select(*cols).unionByName(align_fuzzy(rest, anchors, threshold).select(*cols))


def align_nodes(nodes: DataFrame, threshold: float = 0.90) -> DataFrame:
    """All nodes with an entity id; ``anchor_id`` names the anchor a name-only node folded into."""
    keyed = align_doi(nodes)
    found = resolve_names(keyed, threshold).select(
        F.col("type").alias("_target"), F.col("norm").alias("_norm"), "anchor_entity", "anchor_id"
    )
    open_ = F.col("entity_id").isNull()
    # nodes that cannot fold stay out of the join; without a target and a name they would be one hot key
    keyed = keyed.withColumn("_target", F.when(open_, _target(F.col("type"))))
    cols = [*keyed.columns, "anchor_entity", "anchor_id"]
    named = keyed.where(F.col("_target").isNotNull()).withColumn("_norm", normalize_name(F.col("name")))
    none = F.lit(None).cast("string")
    rest = keyed.where(F.col("_target").isNull()).withColumns({"anchor_entity": none, "anchor_id": none})
    joined = named.join(found, ["_target", "_norm"], "left").select(*cols).unionByName(rest.select(*cols))
    hit = open_ & F.col("anchor_entity").isNotNull()
    hashed = fallback_id(F.coalesce("source", F.lit("unknown")), F.col("type"), F.coalesce("name", F.lit("")))
    return joined.select(
        *[c for c in nodes.columns if c not in ("entity_id", "type")],
        F.when(hit, F.col("_target")).otherwise(F.col("type")).alias("type"),
        F.col("type").alias("raw_type"),
        F.when(~open_, F.col("entity_id")).when(hit, F.col("anchor_entity")).otherwise(hashed).alias("entity_id"),
        F.when(hit, F.col("anchor_id")).alias("anchor_id"),
        open_.alias("was_open"),
    )


def alignment_audit(aligned: DataFrame) -> DataFrame:
    """One row per node resolved by name or hash."""
    return aligned.where("was_open").select("entity_id", "type", "name", "source", "anchor_id")


def alignment_counts(aligned: DataFrame) -> DataFrame:
    return aligned.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.col("entity_id") == F.col("id")).alias("anchored"),
        F.count_if(F.col("anchor_id").isNotNull()).alias("string_aligned"),
    )


def rewrite_triples(triples: DataFrame, aligned: DataFrame, rows: int = 0) -> DataFrame:
    """Both ends mapped to entity ids and folded types; a triple without both nodes is dropped.

    ``rows`` is the number of triples where it is known and no tail is hot; the tasks of their join then follow it.
    """
    ends = aligned.select("id", F.col("raw_type").alias("rt"), "entity_id", "type")
    h = ends.toDF("head", "head_type", "head_id", "_ht")
    t = ends.toDF("tail", "tail_type", "tail_id", "_tt")
    by = lambda df, *keys: spread(df, rows, *keys)
    joined = triples.join(h, ["head", "head_type"])
    joined = by(joined, "tail", "tail_type").join(by(t, "tail", "tail_type"), ["tail", "tail_type"])
    rest = [c for c in triples.columns if c not in ("head", "head_type", "tail", "tail_type")]
    return joined.select(
        "head", F.col("_ht").alias("head_type"), "tail", F.col("_tt").alias("tail_type"), *rest, "head_id", "tail_id"
    )
