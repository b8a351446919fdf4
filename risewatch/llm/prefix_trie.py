"""Trie of conversation prefixes: count-min screening of prefix digests, exact grouping of what may be shared.

Every prefix of a conversation has a 128-bit digest, the exclusive or of one hash for each (depth, turn). Digests are
counted in a count-min sketch. An estimate of one proves that no other conversation has the prefix: its node is emitted
where it is, without a shuffle. Only prefixes that may be shared are grouped by digest, exactly.

* Positions and digests are running sums over range slices of the sorted turns with the totals of the slices before, so
  a conversation of any length is spread over tasks. Texts are never shuffled, only their hashes and lengths.
* A node belongs to its least member. Weights of nodes are summed upwards along the rows of their owner, and the sums of
  all members of a node are its subtree, so the number of passes doesn't depend on the depth.
* Groups are reduced before each shuffle. A parent with very many children is met by a broadcast of at most ``HEAVY``
  nodes. The only thing that follows one group row by row is the digest of the ids that end at a node: SHA-256 is
  sequential, it reads sorted ids as a stream in constant memory.

Nulls: a null turn comes first; a null role or text is empty; rows without a conversation id belong to no conversation.
Rows of one conversation with equal turns are ordered by the MD5 of role and text. Repeated rows are further turns. An
empty table has no nodes. Ids may be of any type that can be ordered (``rebuild`` asks for whole numbers). Input columns
other than the four named are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from risewatch.llm.common import stored

#: Cells of one sketch row: eight for each prefix, between these bounds. The sketch has two rows of one byte a cell,
#: so it never exceeds 32 MB; beyond two million prefixes it proves fewer singletons and more rows are grouped exactly.
CELLS = (1 << 16, 1 << 24)
#: Cells of a piece of the sketch that is merged and sent as one row.
PIECE = 1 << 16
#: Nodes that may be broadcast: a node with at least 1/HEAVY of all grouped rows is one of at most HEAVY.
HEAVY = 2000
#: Largest count a cell holds.
FULL = 255


def hashed_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``key`` (MD5 of role and text) and ``n_chars`` of every row: a narrow pass."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), key.alias("key"), F.length(text).cast("bigint").alias("n_chars"))
    return turns.where(F.col("conv").isNotNull())


def sliced(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` in range slices of (conv, order), stored, so that the slices cannot change when a task runs again."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, F.col("conv"), *order).withColumn("slice", F.spark_partition_id()), name)


def elsewhere(df: DataFrame, **values: tuple[str, Column]) -> DataFrame:
    """For every conversation cut by slices: each value over its other slices, ``before`` or ``after`` this one.

    At most two rows for each slice, for a slice boundary cuts one conversation: small enough to broadcast.
    """
    kind = {"before": (W.unboundedPreceding, -1), "after": (1, W.unboundedFollowing)}
    over = lambda side: W.partitionBy("conv").orderBy("slice").rowsBetween(*kind[side])
    parts = df.groupBy("conv", "slice").agg(*(c.alias(k) for k, (_, c) in values.items()))
    joint = parts.withColumn("parts", F.count(F.lit(1)).over(W.partitionBy("conv"))).where(F.col("parts") > 1)
    outer = {k: (F.bit_xor(k) if k.startswith("x") else F.sum(k)).over(over(side)) for k, (side, _) in values.items()}
    return F.broadcast(joint.select("conv", "slice", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(k) for k, c in outer.items())))


def within(order: list[Column]):
    return W.partitionBy("slice", "conv").orderBy(*order)


def in_order(turns: DataFrame) -> DataFrame:
    """Turns with ``at``, their place in the conversation from 1."""
    order = [F.asc_nulls_first("turn"), F.asc("key")]
    cut = sliced(turns, order, "turns")
    before = elsewhere(cut, skipped=("before", F.count(F.lit(1))))
    ranked = cut.withColumn("at", F.row_number().over(within(order))).join(before, ["slice", "conv"], "left")
    return ranked.select("conv", (F.col("at") + F.coalesce("skipped", F.lit(0))).alias("at"), "key", "n_chars")


def rebuild(ordered: DataFrame, span: int = 100, most: int = 6) -> DataFrame:
    """Conversation ``c`` opens with the first ``crc32(c) % most`` turns of ``c - c % span`` and goes on with its own later turns.

    Returns ``conv``, ``phase`` and ``at`` (the order of turns), ``key`` and ``n_chars``, with one row of phase 0 for each
    conversation, so that one without turns is still there.
    """
    ordered = stored(ordered, "ordered")
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = ordered.select("conv").distinct()
    opening = ordered.where((F.col("conv") % span == 0) & (F.col("at") < most)).withColumnRenamed("conv", "base")
    borrowed = convs.withColumn("base", F.col("conv") - F.col("conv") % span).withColumn("taken", taken).join(opening, "base").where(F.col("at") <= F.col("taken"))
    shape = lambda df, phase: df.select("conv", F.lit(phase).alias("phase"), "at", "key", "n_chars")
    return rooted(shape(borrowed, 1).unionByName(shape(ordered.where(F.col("at") > taken), 2)), convs)


def rooted(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns (conv, phase, at, key, n_chars) with the empty prefix of every conversation."""
    root = convs.select("conv", F.lit(0).alias("phase"), F.lit(0).cast("bigint").alias("at"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("bigint").alias("n_chars"))
    return root.unionByName(turns.withColumn("at", F.col("at").cast("bigint")))


def prefixes(turns: DataFrame) -> DataFrame:
    """One row for each prefix: ``conv``, ``slice``, ``depth``, digest ``d1, d2``, the parent's ``p1, p2``, ``n_chars``, ``last``."""
    order = [F.asc("phase"), F.asc("at")]
    cut = sliced(turns, order, "rebuilt")
    rows = F.count(F.lit(1))
    around = elsewhere(cut, skipped=("before", rows), later=("after", rows))
    placed = (
        cut.withColumn("place", F.row_number().over(within(order)))
        .withColumn("ends", F.lead("place").over(within(order)).isNull())
        .join(around, ["slice", "conv"], "left")
        .withColumn("depth", (F.col("place") - 1 + F.coalesce("skipped", F.lit(0))).cast("bigint"))
        .withColumn("last", F.col("ends") & (F.coalesce("later", F.lit(0)) == 0))
    )
    term = lambda seed: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "key")).otherwise(F.lit(0))
    termed = placed.select("slice", "conv", "depth", "n_chars", "last", term(1).alias("t1"), term(2).alias("t2"))
    sums = elsewhere(termed, x1=("before", F.bit_xor("t1")), x2=("before", F.bit_xor("t2")))
    run = within([F.asc("depth")]).rowsBetween(W.unboundedPreceding, 0)
    digested = (
        termed.withColumn("r1", F.bit_xor("t1").over(run))
        .withColumn("r2", F.bit_xor("t2").over(run))
        .join(sums, ["slice", "conv"], "left")
        .withColumn("d1", F.col("r1").bitwiseXOR(F.coalesce("x1", F.lit(0))))
        .withColumn("d2", F.col("r2").bitwiseXOR(F.coalesce("x2", F.lit(0))))
    )
    up = lambda d, t: F.when(F.col("depth") > 0, F.col(d).bitwiseXOR(F.col(t)))
    return digested.select("conv", "slice", "depth", "d1", "d2", up("d1", "t1").alias("p1"), up("d2", "t2").alias("p2"), "n_chars", "last")


def width(n: int) -> int:
    """Cells of a sketch row for ``n`` prefixes: a power of two within ``CELLS``."""
    low, high = CELLS
    return min(high, max(low, 1 << (8 * max(n, 1) - 1).bit_length()))


def count_min(rows: DataFrame, d1: str, d2: str, cells: int) -> np.ndarray:
    """Two rows of ``cells`` saturated counters; row r is indexed by the low bits of digest half r.

    Each task fills a sketch of its own and sends the cells it touched, so no more than six bytes a prefix are shuffled
    and no more than a whole sketch a task. What the driver gets is the merged sketch, 32 MB at most.
    """
    mask = cells - 1

    def fill(batches):
        own = np.zeros((2, cells), np.uint8)
        for batch in batches:
            for r in (0, 1):
                at, n = np.unique(batch.column(r).to_numpy() & mask, return_counts=True)
                own[r, at] = np.minimum(FULL, own[r, at] + n)
        flat = own.reshape(-1)
        for k in range(0, len(flat), PIECE):
            part = flat[k : k + PIECE]
            at = np.flatnonzero(part)
            if len(at):
                dense = 3 * len(at) >= PIECE
                body = part.tobytes() if dense else at.astype(np.uint16).tobytes() + part[at].tobytes()
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k // PIECE], pa.int32()), "dense": [dense], "body": pa.array([body], pa.binary())})

    def merge(batches):
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, dense, body in zip(*(c.to_pylist() for c in batch.columns)):
                into = whole.setdefault(piece, np.zeros(PIECE, np.uint8))
                n = len(body) if dense else len(body) // 3
                at = slice(None) if dense else np.frombuffer(body, np.uint16, n)
                more = np.frombuffer(body, np.uint8, n, 0 if dense else 2 * n)
                into[at] = np.minimum(FULL, into[at].astype(np.int64) + more)
        for piece, part in whole.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "body": pa.array([part.tobytes()], pa.binary())})

    pieces = rows.select(d1, d2).mapInArrow(fill, "piece int, dense boolean, body binary").repartition("piece").mapInArrow(merge, "piece int, body binary")
    sketch = np.zeros((2 * cells) // PIECE * PIECE, np.uint8)
    for piece, body in pieces.collect():
        sketch[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(body, np.uint8)
    return sketch.reshape(2, cells)


def screen(rows: DataFrame, sketch: np.ndarray) -> DataFrame:
    """Prefixes with ``alone`` (proven: no other conversation has it) and ``up_alone`` (the same of the parent)."""
    shared, mask = rows.sparkSession.sparkContext.broadcast(sketch), sketch.shape[1] - 1
    names = rows.columns

    def one(batch, a, b):
        a, b = (batch.column(names.index(c)).fill_null(0).to_numpy() & mask for c in (a, b))
        return np.minimum(shared.value[0, a], shared.value[1, b]) == 1

    def run(batches):
        for batch in batches:
            root = batch.column(names.index("p1")).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one(batch, "d1", "d2")), pa.array(one(batch, "p1", "p2") & ~root)], [*names, "alone", "up_alone"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", alone boolean, up_alone boolean")


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids, comma-joined, for each digest: sorted ids pass as a stream."""
    names = ["d1", "d2", "ends_sha256"]

    def run(batches):
        now, sha = None, None
        for batch in batches:
            out = []
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != now:
                    if sha:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (a, b), hashlib.sha256(conv.encode())
                else:
                    sha.update(b"," + conv.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names)
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([sha.hexdigest()])], names)

    ordered = ends.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "conv").select("d1", "d2", F.col("conv").cast("string").alias("conv"))
    return ordered.mapInArrow(run, "d1 bigint, d2 bigint, ends_sha256 string")


def with_parent(children: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """``children`` with ``parent``, the owner of the node (p1, p2); nodes with very many children are broadcast."""
    owner = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv").alias("parent"), "n_convs")
    often = max(2, -(-rows // HEAVY))
    heavy = F.broadcast(owner.where(F.col("n_convs") >= often).drop("n_convs"))
    light = owner.where(F.col("n_convs") < often).drop("n_convs")
    return children.join(heavy, ["p1", "p2"]).unionByName(children.join(heavy, ["p1", "p2"], "left_anti").join(light, ["p1", "p2"], "left"))


def trie(turns: DataFrame) -> DataFrame:
    """All nodes of rooted turns (``rebuild``, ``rooted``): conv, depth, parent, n_convs, n_children, n_leaves, saved, ends_sha256."""
    rows = stored(prefixes(turns), "prefixes")
    sketch = count_min(rows, "d1", "d2", width(rows.count()))
    rows = stored(screen(rows, sketch), "screened")
    maybe, single = rows.where(~F.col("alone")), rows.where("alone")

    # Exact groups of the prefixes that may be shared.
    node = ["d1", "d2"]
    groups = stored(
        maybe.groupBy(*node).agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), F.min("depth").alias("depth"), F.min("n_chars").alias("n_chars"),
            F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("up_alone").alias("up_alone"),
        ),
        "groups",
    )
    heads = single.where(~F.col("up_alone") & F.col("p1").isNotNull())
    below = groups.where(F.col("p1").isNotNull()).select("p1", "p2").unionByName(heads.select("p1", "p2"))
    children = below.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count(F.lit(1)).alias("n_children"))
    groups = stored(groups.join(children, node, "left").fillna(0, ["n_children"]), "nodes")

    # A node's weights lie on its owner's row; a row's suffix sums along its conversation hold all owned below it.
    weights = groups.select("conv", "depth", ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"), (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    alone_end = F.when(F.col("alone") & F.col("last"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    weighed = rows.where(~F.col("alone") | F.col("last")).join(weights, ["conv", "depth"], "left").select(
        "conv", "slice", "depth", *node, "alone", "last", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce(F.when(~F.col("alone"), F.col("leaf")), alone_end).alias("leaf")
    )
    weighed = stored(weighed, "weighed")
    later = elsewhere(weighed, more_saved=("after", F.sum("saved")), more_leaf=("after", F.sum("leaf")))
    back = within([F.desc("depth")]).rowsBetween(W.unboundedPreceding, 0)
    summed = (
        weighed.withColumn("saved", F.sum("saved").over(back))
        .withColumn("leaf", F.sum("leaf").over(back))
        .join(later, ["slice", "conv"], "left")
        .where(~F.col("alone"))
        .groupBy(*node)
        .agg(F.sum(F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.sum(F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).alias("n_leaves"))
    )
    ends = end_digests(maybe.where("last").select(*node, "conv"))
    nobody = F.sha2(F.lit("").cast("binary"), 256)
    n = maybe.count()
    own = F.col("p1").isNull() | F.col("up_alone")
    inner = groups.where(own).withColumn("parent", F.when(F.col("p1").isNotNull(), F.col("conv"))).unionByName(with_parent(groups.where(~own), groups, n))
    inner = inner.join(summed, node).join(ends, node, "left").select(
        "conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends_sha256", nobody).alias("ends_sha256")
    )

    # Proven singletons: all but the first of a tail know everything.
    tail = single.where(F.col("up_alone") | F.col("p1").isNull()).withColumn("parent", F.when(F.col("p1").isNotNull(), F.col("conv")))
    alone = tail.unionByName(with_parent(heads, groups, n)).select(
        "conv", "depth", "parent", F.lit(1).cast("bigint").alias("n_convs"), (~F.col("last")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved"), F.when(F.col("last"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(nobody).alias("ends_sha256"),
    )
    return inner.unionByName(alone)


def conversation_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations as they are."""
    ordered = stored(in_order(hashed_turns(df, conv, turn, role, text)), "ordered")
    return trie(rooted(ordered.select("conv", F.lit(1).alias("phase"), "at", "key", "n_chars"), ordered.select("conv").distinct()))
