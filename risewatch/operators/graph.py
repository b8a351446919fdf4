"""Temporal concept graph: co-occurrence projection, directed facts, splits, ids, upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from risewatch.operators import pairs as P
from risewatch.operators.core import attach, global_rank, occurrences, total
from risewatch.schemas import DIRECTED_TYPES, DOC_TYPES, EDGE_RELATIONS, NODE_TYPES, PAIR_RELATIONS
from risewatch.session import durable

HUB_SIZE = 256  # a document with more distinct concepts than this is cut into blocks of as many
WIDE = 2048  # a document with more distinct concepts than this is never expanded alone
SALTS = 16


def doc_concepts(triples: DataFrame, doc_types: Sequence[str] = DOC_TYPES, max_time: str | None = None) -> DataFrame:
    """Distinct ``(doc, concept)`` with the document's earliest non-empty time (null when undated)."""
    time = F.coalesce("time", F.lit(""))
    rows = triples.where(F.col("head_type").isin(*doc_types) & (F.col("tail_type") == "Concept") & (F.col("tail") != ""))
    if max_time is not None:
        rows = rows.where(time <= max_time)
    # shuffled by document, so that the arrays of a document need no second shuffle
    by_doc = rows.select(F.col("head").alias("doc"), F.col("tail").alias("concept"), F.when(time != "", time).alias("time")).repartition("doc")
    return by_doc.groupBy("doc", "concept").agg(F.min("time").alias("time"))


def doc_arrays(docs: DataFrame) -> DataFrame:
    """``doc, hub, time, concepts``: the sorted concepts of each document, of a hub (above ``WIDE``) in parts of ``WIDE``."""
    own = W.partitionBy("doc").orderBy("concept")
    whole = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    placed = docs.select(
        "doc", "concept", "time", (F.count(F.lit(1)).over(whole) > WIDE).alias("hub"), F.floor((F.row_number().over(own) - 1) / WIDE).alias("_part")
    )
    arrays = placed.groupBy("doc", "hub", "_part").agg(F.min("time").alias("time"), F.array_sort(F.collect_list("concept")).alias("concepts"))
    return arrays.select("doc", "hub", "time", "concepts")


def _split_hubs(stored: DataFrame, hub_size: int) -> tuple[DataFrame, DataFrame]:
    """Bounded arrays that hold each pair of a document once, and the single rows of hubs.

    A document of more than ``hub_size`` concepts gives one array for each block of as many and, with the size of the
    first as ``cut``, for each two blocks.
    """
    size, n = max(hub_size, 1), F.size("concepts")
    last = F.floor((n - 1) / size).cast("int")
    block = lambda i: F.slice("concepts", i * size + 1, size)
    two = lambda i, j: F.struct(F.when(j > i, F.concat(block(i), block(j))).otherwise(block(i)).alias("concepts"), F.when(j > i, size).otherwise(0).alias("cut"))
    blocks = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: two(i, j))))
    rows = F.when(n <= size, F.array(F.struct("concepts", F.lit(0).alias("cut")))).otherwise(blocks)
    arrays = stored.where(~F.col("hub")).select("doc", "time", F.inline(rows))
    return arrays, stored.where("hub").select("doc", "time", F.explode("concepts").alias("concept"))


def _salted_pairs(rows: DataFrame) -> DataFrame:
    """Canonical pairs inside large documents; each document is spread over ``SALTS`` tasks."""
    left = rows.select("doc", "time", F.col("concept").alias("a")).withColumn("_salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    right = rows.select("doc", F.col("concept").alias("b")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    )
    return left.join(right, ["doc", "_salt"]).where(F.col("a") < F.col("b")).drop("_salt")


def pair_support(docs: DataFrame, min_cooccur: int = 2, hub_size: int = HUB_SIZE) -> DataFrame:
    """Documents per unordered concept pair, pairs below ``min_cooccur`` removed.

    Documents emit their pairs from bounded arrays, counted inside the task, but only pairs that may be frequent: concepts of
    too few documents go first, then pairs whose hashed cell was counted too seldom, so what is shuffled is close to the
    pairs that stay. Hubs (above ``WIDE``) are never expanded alone: a pair is kept only if enough documents hold it, so hub rows
    matter only for (1) pairs already seen in another document, looked up by both ends, and (2) concepts that occur
    in at least ``min_cooccur`` hubs. A pair of concepts that hubs hold too is never pruned.
    """
    return _support(durable(doc_arrays(docs)), min_cooccur, hub_size)


def _support(stored: DataFrame, min_cooccur: int, hub_size: int) -> DataFrame:
    arrays, hubs = _split_hubs(stored, hub_size)
    alone = hubs.isEmpty()
    concepts = cells = always = None
    if min_cooccur > 1:
        concepts = P.frequent_concepts(stored.where(~F.col("hub")), min_cooccur)
        cells = P.frequent_cells(arrays, min_cooccur, concepts)
        always = None if alone else P.concept_cells(hubs)
    seen = P.counted_pairs(arrays, cells, concepts, always).groupBy("a", "b").agg(F.sum("n").alias("n"))
    if alone:
        return seen.where(F.col("n") >= min_cooccur)
    seen = durable(seen)
    frequent = hubs.groupBy("concept").agg(F.count(F.lit(1)).alias("_in")).where(F.col("_in") >= min_cooccur)
    only_hubs = (
        _salted_pairs(hubs.join(frequent.select("concept"), "concept", "left_semi")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("h"))
    )
    looked_up = _hub_hits(hubs, seen.select("a", "b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("h"))
    mixed = seen.join(looked_up, ["a", "b"], "left").select(
        "a", "b", (F.col("n") + F.coalesce("h", F.lit(0))).alias("n")
    )
    fresh = only_hubs.join(seen.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", F.col("h").alias("n"))
    return mixed.unionByName(fresh).where(F.col("n") >= min_cooccur)


def _hub_hits(hubs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(doc, a, b)`` for every given pair inside a hub document, driven by the end found in fewer hubs."""
    spread = hubs.groupBy("concept").agg(F.count(F.lit(1)).alias("_n"))
    sized = pairs.join(spread.toDF("a", "_na"), "a").join(spread.toDF("b", "_nb"), "b")
    rare = F.when(F.col("_na") <= F.col("_nb"), F.col("a")).otherwise(F.col("b"))
    other = F.when(F.col("_na") <= F.col("_nb"), F.col("b")).otherwise(F.col("a"))
    driven = sized.select("a", "b", rare.alias("_rare"), other.alias("_other"))
    return (
        driven.join(hubs.select("doc", F.col("concept").alias("_rare")), "_rare")
        .join(hubs.select("doc", F.col("concept").alias("_other")), ["doc", "_other"], "left_semi")
        .select("doc", "a", "b")
    )


def cap_entities(pairs: DataFrame, max_entities: int) -> DataFrame:
    """Pairs whose two ends are among the ``max_entities`` of highest degree (ties by id)."""
    degree = (
        pairs.select(F.explode(F.array("a", "b")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("deg"))
    )
    keep = degree.orderBy(F.desc("deg"), "entity").limit(max_entities).select("entity")
    return pairs.join(keep.withColumnRenamed("entity", "a"), "a", "left_semi").join(
        keep.withColumnRenamed("entity", "b"), "b", "left_semi"
    )


def project_cooccurrence(
    triples: DataFrame,
    relation: str = "relates_to",
    min_cooccur: int = 2,
    max_entities: int | None = None,
    doc_types: Sequence[str] = ("Paper", "Patent", "Repo"),
    max_time: str | None = None,
    hub_size: int = HUB_SIZE,
    counted: bool = False,
) -> DataFrame:
    """Document-concept quads to dated concept-concept facts, one per direction and document.

    ``max_entities`` is a top-k by degree for those who ask for one; by default every entity stays. With ``counted``
    equal facts are one row with their number in ``n``.
    """
    # documents of one day lie together, so that their pairs are counted before they are shuffled
    arrays = doc_arrays(doc_concepts(triples, doc_types, max_time)).hint("rebalance", "time")
    stored = durable(arrays.sortWithinPartitions("time"))
    kept = durable(_support(stored, min_cooccur, hub_size))
    if max_entities is not None:
        kept = durable(cap_entities(kept, max_entities))
    facts = _facts(stored, kept, relation, hub_size)
    return facts if counted else _repeated(facts)


def pair_facts(docs: DataFrame, kept: DataFrame, relation: str = "relates_to", hub_size: int = HUB_SIZE) -> DataFrame:
    """One fact per direction for every dated document holding a kept pair."""
    return _repeated(_facts(durable(doc_arrays(docs)), kept, relation, hub_size))


def _repeated(facts: DataFrame) -> DataFrame:
    return facts.select("head", "relation", "tail", "time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("_i")).drop("_i")


def _facts(stored: DataFrame, kept: DataFrame, relation: str, hub_size: int) -> DataFrame:
    """Facts of the kept pairs with the number of documents in ``n``."""
    arrays, hubs = _split_hubs(stored, hub_size)
    pairs = P.counted_pairs(arrays.where("time is not null"), P.cells_of_pairs(kept), timed=True)
    if not hubs.isEmpty():
        times = hubs.groupBy("doc").agg(F.min("time").alias("time")).where("time is not null")
        found = _hub_hits(hubs, kept.select("a", "b")).join(times, "doc")
        pairs = pairs.unionByName(found.select("time", "a", "b", F.lit(1).cast("bigint").alias("n")))
    both = pairs.groupBy("time", "a", "b").agg(F.sum("n").alias("n")).join(kept.select("a", "b"), ["a", "b"], "left_semi")
    ends = F.explode(
        F.array(
            F.struct(F.col("a").alias("head"), F.col("b").alias("tail")),
            F.struct(F.col("b").alias("head"), F.col("a").alias("tail")),
        )
    )
    return both.select(ends.alias("e"), "time", "n").select("e.head", F.lit(relation).alias("relation"), "e.tail", "time", "n")


def directed_facts(
    triples: DataFrame,
    relations: Sequence[str] = PAIR_RELATIONS,
    min_support: int = 2,
    max_time: str | None = None,
) -> DataFrame:
    """Technology-to-technology facts: edges seen at least ``min_support`` times, one row per distinct time."""
    rows = triples.where(
        F.col("head_type").isin(*DIRECTED_TYPES)
        & F.col("tail_type").isin(*DIRECTED_TYPES)
        & F.col("relation").isin(*relations)
        & (F.col("head") != "")
        & (F.col("tail") != "")
        & (F.col("time") != "")
    )
    if max_time is not None:
        rows = rows.where(F.col("time") <= max_time)
    edge = ["head", "relation", "tail"]
    by_time = rows.groupBy(*edge, "time").agg(F.count(F.lit(1)).alias("_c"))
    strong = by_time.groupBy(*edge).agg(F.sum("_c").alias("_n")).where(F.col("_n") >= min_support)
    return by_time.join(strong, edge, "left_semi").select(*edge, "time")


def temporal_split(facts: DataFrame, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """``role`` train / val / test by whole timestamps, no timestamp is split; counted facts weigh their ``n``.

    Days are ordered first (a calendar of them), timestamps only inside their day.
    """
    time = F.coalesce("time", F.lit(""))
    times = facts.groupBy(time.alias("_time")).agg(occurrences(facts).alias("_c")).withColumn("_day", F.substring("_time", 1, 10))
    days = times.groupBy("_day").agg(F.sum("_c").alias("_d"))
    prior = W.rowsBetween(W.unboundedPreceding, -1)
    earlier_days = F.coalesce(F.sum("_d").over(prior.orderBy("_day")), F.lit(0))
    earlier_same_day = F.coalesce(F.sum("_c").over(prior.partitionBy("_day").orderBy("_time")), F.lit(0))
    before = times.join(days.withColumn("_b", earlier_days), "_day").withColumn("_before", F.col("_b") + earlier_same_day)
    placed = attach(before, days.agg(F.sum("_d").alias("_n")))
    end = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(train)))
    val_end = F.greatest(end + 1, F.floor(F.col("_n") * F.lit(train + val)))
    role = F.when(F.col("_before") < end, "train").when(F.col("_before") < val_end, "val").otherwise("test")
    roles = placed.select("_time", role.alias("role"))
    return facts.withColumn("_time", time).join(roles, "_time").drop("_time")


def ordered_split(facts: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Earliest ``int(n * ratio)`` facts are train, the rest test; equal times in edge order.

    Days are ordered by their counts (a calendar of them); only facts of the day in which the cut falls are ranked.
    """
    keys = ["time", "head", "relation", "tail"]
    copies = durable(facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")))
    # a null time comes first; a day is a prefix of its times, so days are in the order of the times
    copies = copies.withColumn("_day", F.coalesce(F.concat(F.lit("t"), F.substring("time", 1, 10)), F.lit("")))
    days = copies.groupBy("_day").agg(F.sum("_c").alias("_d"))
    days = attach(days.withColumn("_end", F.sum("_d").over(W.orderBy("_day"))), days.agg(F.floor(F.sum("_d") * F.lit(ratio)).alias("_cut")))
    past = F.col("_end") > F.col("_cut")
    first = days.where(past).agg(F.min("_day").alias("_at"), F.min_by(F.col("_cut") - F.col("_end") + F.col("_d"), "_day").alias("_left"))
    placed = attach(copies, durable(first))
    whole = placed.where(F.col("_at").isNull() | (F.col("_day") != F.col("_at"))).withColumn(
        "role", F.when(F.col("_at").isNull() | (F.col("_day") < F.col("_at")), "train").otherwise("test")
    )
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_c"))).alias("copy")
    ranked = global_rank(placed.where(F.col("_day") == F.col("_at")).select(*keys, "_left", each), [F.asc(c) for c in [*keys, "copy"]])
    cut = ranked.withColumn("role", F.when(F.col("rn") <= F.col("_left"), "train").otherwise("test"))
    cols = ["head", "relation", "tail", "time", "role"]
    return whole.select(*cols, each).drop("copy").unionByName(cut.select(*cols))


def hash_split(facts: DataFrame, ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Reproducible random split on a seeded hash of the whole fact."""
    digits = F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in facts.columns], F.lit(str(seed)))), 1, 8)
    slot = F.conv(digits, 16, 10).cast("bigint") % 10000
    return facts.withColumn("role", F.when(slot < int(ratio * 10000), "train").otherwise("test"))


def encode_entities(facts: DataFrame) -> DataFrame:
    """Entities of both ends with dense ids in name order, from 0."""
    names = facts.select(F.explode(F.array("head", "tail")).alias("entity")).distinct()
    return global_rank(names, [F.asc("entity")]).select("entity", (F.col("rn") - 1).alias("entity_id"))


def encode_relations(facts: DataFrame) -> DataFrame:
    names = facts.select("relation").distinct()
    return global_rank(names, [F.asc("relation")]).select("relation", (F.col("rn") - 1).alias("relation_id"))


def node_properties(nodes: DataFrame) -> DataFrame:
    """Properties kept per label; rows with an unknown label are dropped."""
    label = F.col("type")
    paper = label.isin("Paper", "Patent")
    linked = label.isin("Repo", "News")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return nodes.where(label.isin(*NODE_TYPES)).select(
        "type",
        "entity_id",
        "source",
        F.when(paper, F.col("name")).alias("title"),
        F.when(~paper, F.col("name")).alias("name"),
        F.when(paper, blank("pub_date")).alias("pub_date"),
        F.when(linked, blank("url")).alias("url"),
        F.when(label == "Repo", F.coalesce("stars", F.lit(0))).alias("stars"),
        F.when(label == "News", F.col("tone")).alias("tone"),
        blank("doi").alias("doi"),
        blank("kind").alias("kind"),
    )


def upsert_nodes(nodes: DataFrame, version: Column, existing: DataFrame | None = None) -> DataFrame:
    """One row per (type, entity id); a later non-null property overwrites, the always-set ones by last row."""
    keyed = nodes.withColumn("_v", version)
    typed = node_properties(nodes).columns
    rows = keyed.where(F.col("type").isin(*NODE_TYPES))
    fresh = _properties_with_version(rows)
    if existing is not None:
        fresh = fresh.unionByName(existing.select(*typed).withColumn("_v", F.lit(-1).cast("bigint")))
    attrs = [c for c in typed if c not in ("type", "entity_id")]
    return fresh.groupBy("type", "entity_id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_v"))).alias(c) for c in attrs]
    )


def _properties_with_version(rows: DataFrame) -> DataFrame:
    packed = rows.withColumn("source", F.struct("source", "_v"))
    out = node_properties(packed)
    return out.withColumn("_v", F.col("source._v")).withColumn("source", F.col("source.source"))


def upsert_edges(edges: DataFrame, version: Column, existing: DataFrame | None = None) -> DataFrame:
    """One row per (labels, ends, relation); the last write decides time and source."""
    key = ["head_type", "head_id", "relation", "tail_type", "tail_id"]
    ok = (
        F.col("relation").isin(*EDGE_RELATIONS)
        & F.col("head_type").isin(*NODE_TYPES)
        & F.col("tail_type").isin(*NODE_TYPES)
    )
    rows = edges.where(ok).select(*key, "time", "source", version.alias("_v"))
    if existing is not None:
        rows = rows.unionByName(existing.select(*key, "time", "source").withColumn("_v", F.lit(-1).cast("bigint")))
    last = F.max_by(F.struct("time", "source"), "_v").alias("_b")
    return rows.groupBy(*key).agg(last).select(*key, "_b.time", "_b.source")


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge totals; edge ends without a node row count as nodes too."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("head_type").alias("type"), F.col("head_id").alias("entity_id")),
                F.struct(F.col("tail_type").alias("type"), F.col("tail_id").alias("entity_id")),
            )
        ).alias("e")
    ).select("e.type", "e.entity_id")
    every = nodes.select("type", "entity_id").unionByName(ends).distinct()
    return attach(total(every, "nodes"), total(edges, "edges"))


def transductive(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test facts whose head, tail and relation all occur in train."""
    seen = train.select(F.explode(F.array("head", "tail")).alias("e")).distinct()
    return (
        test.join(seen.withColumnRenamed("e", "head"), "head", "left_semi")
        .join(seen.withColumnRenamed("e", "tail"), "tail", "left_semi")
        .join(train.select("relation").distinct(), "relation", "left_semi")
        .select(*test.columns)
    )
