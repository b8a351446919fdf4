"""Low-rank factors of edge counts for many groups (folds) in one job: alternating least squares with the group in every key.

Each half step joins the edges with the vectors of one end and solves the other end's ridge systems while sorted edges
stream through the task; nothing is fitted group after group. An end with more than ``SPLIT`` edges is cut into parts
whose partial systems are added, so a hot entity is never solved from one task's rows, and its own vector is copied to
as many parts when it is the side that is looked up.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risewatch.operators.core import occurrences, small
from risewatch.operators.links import train_entities
from risewatch.session import durable

#: Edges of one end that one task solves from.
SPLIT = 4096


def group_key(by: Sequence[str]):
    """The ``by`` columns as one string, the key inside Arrow functions."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]) if by else F.lit("")


def start(entities: DataFrame, dim: int, seed: int) -> DataFrame:
    """Reproducible positive start vectors from a hash of the entity."""
    part = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.pmod(F.xxhash64(F.lit(seed), "entity", i), F.lit(1 << 20)) / F.lit(float((1 << 20) * dim**0.5)))
    return entities.withColumn("vec", part)


def _edges(train: DataFrame, by: Sequence[str]) -> tuple[DataFrame, dict[str, DataFrame | None]]:
    """Counted edges with the number of parts of each end and the edge's part in it; the ends of several parts, if any."""
    hot: dict[str, DataFrame | None] = {}
    edges = durable(train.groupBy(group_key(by).alias("_g"), "head", "tail").agg(occurrences(train).cast("double").alias("c")))
    for end, other in (("head", "tail"), ("tail", "head")):
        many = edges.groupBy("_g", end).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > SPLIT)
        parts = durable(many.select("_g", end, F.ceil(F.col("_d") / SPLIT).cast("int").alias(f"_{end}_parts")))
        hot[end] = None if parts.isEmpty() else small(parts)
        joined = edges.withColumn(f"_{end}_parts", F.lit(None).cast("int")) if hot[end] is None else edges.join(hot[end], ["_g", end], "left")
        edges = (
            joined.withColumn(f"_{end}_parts", F.coalesce(f"_{end}_parts", F.lit(1)))
            .withColumn(f"_{end}_part", F.pmod(F.xxhash64(other), F.col(f"_{end}_parts")).cast("int"))
        )
    return durable(edges), hot


def _gram(factors: DataFrame, dim: int) -> dict[str, np.ndarray]:
    """``V'V`` of each group: groups x dim x dim numbers."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            groups, vecs = np.array(batch.column(0).to_pylist()), batch.column(1).flatten().to_numpy().reshape(-1, dim)
            for g in set(groups.tolist()):
                v = vecs[groups == g]
                sums[g] = sums.get(g, 0) + v.T @ v
        for g, m in sums.items():
            yield pa.RecordBatch.from_pydict({"_g": pa.array([g] * dim * dim), "i": pa.array(range(dim * dim), pa.int32()), "x": pa.array(m.ravel())})

    rows = factors.select("_g", "vec").mapInArrow(run, "_g string, i int, x double").groupBy("_g", "i").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["_g"], np.zeros(dim * dim))[r["i"]] = r["x"]
    return {g: m.reshape(dim, dim) for g, m in out.items()}


def _solve(edges: DataFrame, hot: dict[str, DataFrame | None], factors: DataFrame, end: str, other: str, dim: int, reg: float) -> DataFrame:
    """Vectors of ``end`` from the vectors of ``other``, as ``_g, entity, vec``; only entities with edges."""
    gram = edges.sparkSession.sparkContext.broadcast(_gram(factors, dim))
    copies = factors.select("_g", F.col("entity").alias(other), "vec").withColumn(f"_{other}_part", F.lit(0))
    if hot[other] is not None:
        every = F.explode(F.sequence(F.lit(0), F.coalesce(f"_{other}_parts", F.lit(1)) - 1))
        copies = copies.join(hot[other], ["_g", other], "left").withColumn(f"_{other}_part", every).drop(f"_{other}_parts")
    work = (
        edges.join(copies, ["_g", other, f"_{other}_part"])
        .select("_g", F.col(end).alias("entity"), F.col(f"_{end}_part").alias("part"), F.col(f"_{end}_parts").alias("parts"), "c", "vec")
        .repartition("_g", "entity", "part")
        .sortWithinPartitions("_g", "entity", "part")
    )
    names = ["_g", "entity", "parts", "vec"]

    def finish(g, system):
        n, a, b = system[0], system[1 : 1 + dim * dim].reshape(dim, dim), system[1 + dim * dim :]
        return np.linalg.solve(gram.value[g] + a + reg * n * np.eye(dim), b)

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64())))], names)

    def gather(batches):
        """Runs of one (group, entity, part): their vector, or their partial system when there are more parts."""
        now, total = None, None

        def done():
            return (*now[:2], now[3], finish(now[0], total) if now[3] == 1 else total)

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            c, v = batch.column(4).to_numpy(), batch.column(5).flatten().to_numpy().reshape(-1, dim)
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            out = []
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                y, w = v[lo:hi], c[lo:hi]
                system = np.concatenate([[hi - lo], (y.T @ (w[:, None] * y)).ravel(), (1 + w) @ y])
                if keys[lo] == now:
                    total = total + system
                else:
                    if now:
                        out.append(done())
                    now, total = keys[lo], system
            if out:
                yield emit(out)
        if now:
            yield emit([done()])

    def add(batches):
        now, total = None, None
        for batch in batches:
            for g, entity, parts, system in zip(*(c.to_pylist() for c in batch.columns)):
                if (g, entity) != now:
                    if now:
                        yield emit([(*now, 1, finish(now[0], total))])
                    now, total = (g, entity), np.zeros(len(system))
                total = total + np.array(system)
        if now:
            yield emit([(*now, 1, finish(now[0], total))])

    schema = "_g string, entity string, parts int, vec array<double>"
    if hot[end] is None:
        return work.mapInArrow(gather, schema).select("_g", "entity", "vec")
    first = durable(work.mapInArrow(gather, schema))
    rest = first.where("parts > 1").repartition("_g", "entity").sortWithinPartitions("_g", "entity").mapInArrow(add, schema)
    return first.where("parts = 1").unionByName(rest).select("_g", "entity", "vec")


def fit_factors(
    train: DataFrame, by: Sequence[str] = (), dim: int = 16, seed: int = 42, max_iter: int = 5, reg: float = 0.1, entities: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Head and entity factors ``(by…, entity, vec)`` of implicit-feedback least squares on the edge counts of every group.

    An entity without edges on a side has zeros there. Rows with a null end are left out.
    """
    by = list(by)
    known = train.where(F.col("head").isNotNull() & F.col("tail").isNotNull())
    every = durable((train_entities(known, by) if entities is None else entities.select(*by, "entity").distinct()).withColumn("_g", group_key(by)))
    edges, hot = _edges(known, by)
    items = durable(start(edges.select("_g", F.col("tail").alias("entity")).distinct(), dim, seed))
    users = items
    for _ in range(max_iter):
        users = durable(_solve(edges, hot, items, "head", "tail", dim, reg))
        items = durable(_solve(edges, hot, users, "tail", "head", dim, reg))
    zero = F.array_repeat(F.lit(0.0), dim)
    return tuple(every.join(f, ["_g", "entity"], "left").select(*by, "entity", F.coalesce("vec", zero).alias("vec")) for f in (users, items))
