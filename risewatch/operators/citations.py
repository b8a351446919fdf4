"""Forward citation facts and cumulative citation series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from risewatch.functions.dates import time_bin
from risewatch.functions.text import blank_to_null
from risewatch.operators.core import attach, global_rank
from risewatch.operators.series import cumulate
from risewatch.session import durable


def forward_citations(backward: DataFrame, min_time: str | None = None, max_time: str | None = None) -> DataFrame:
    """``(citing, cited)`` pairs turned into dated ``cited_by`` facts; bad, undated and out-of-range rows dropped."""
    time = F.coalesce(blank_to_null(F.col("citing_date")), blank_to_null(F.col("cited_date")))
    rows = backward.select(
        F.col("cited").alias("head"),
        F.lit("cited_by").alias("relation"),
        F.col("citing").alias("tail"),
        time.alias("time"),
        F.coalesce("cited_date", F.lit("")).alias("head_date"),
        F.lit("patent_citation").alias("source"),
    ).where((F.col("head") != "") & (F.col("tail") != "") & (F.col("head") != F.col("tail")) & F.col("time").isNotNull())
    if min_time is not None:
        rows = rows.where(F.col("time") >= min_time)
    if max_time is not None:
        rows = rows.where(F.col("time") <= max_time)
    return rows


def citation_counts(facts: DataFrame, mode: str = "month") -> DataFrame:
    """Citations per cited patent and bin."""
    return (
        facts.where((F.col("head") != "") & (F.col("time") != ""))
        .groupBy(F.col("head").alias("entity"), time_bin(F.col("time"), mode).alias("bin"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def cited_totals(counts: DataFrame, min_citations: int = 2) -> DataFrame:
    return counts.groupBy("entity").agg(F.sum("cnt").alias("total")).where(F.col("total") >= min_citations)


def sample_patents(
    totals: DataFrame, sampling: str = "stratified", n_bins: int = 5, per_bin: int = 2000, max_patents: int = 5000
) -> DataFrame:
    """Stratified by equal-width bins of log10(total + 1), or the most cited; ties by id.

    Strata are filled by counting totals first, so only the patents at the one cut-off total of a stratum are
    ordered by id, and those by a range-partitioned numbering.
    """
    if sampling == "top_total":
        return totals.orderBy(F.desc("total"), "entity").limit(max_patents)
    if sampling != "stratified":
        raise ValueError(f"unknown sampling: {sampling!r}")
    level = F.log10(F.col("total") + 1)
    span = totals.agg(F.min(level).alias("_lo"), F.max(level).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / n_bins).otherwise(1.0)
    stratum = F.least(F.lit(n_bins - 1), F.floor((level - F.col("_lo")) / width)).cast("int")
    placed = attach(totals, span).select("entity", "total", stratum.alias("stratum"))
    levels = placed.groupBy("stratum", "total").agg(F.count(F.lit(1)).alias("_c"))
    higher = W.partitionBy("stratum").orderBy(F.desc("total")).rowsBetween(W.unboundedPreceding, -1)
    room = levels.withColumn("_room", per_bin - F.coalesce(F.sum("_c").over(higher), F.lit(0))).where("_room > 0")
    whole = room.where("_c <= _room").select("stratum", "total")
    cut = room.where("_c > _room").select("stratum", "total", "_room")  # at most one level per stratum
    inside = placed.join(whole, ["stratum", "total"], "left_semi")
    tied = placed.join(F.broadcast(cut), ["stratum", "total"])
    edge = global_rank(tied, [F.asc("entity")], ["stratum"]).where("rn <= _room")
    return inside.select("entity", "total", "stratum").unionByName(edge.select("entity", "total", "stratum"))


def kept_counts(facts: DataFrame, mode: str = "month", min_citations: int = 2, sampling: str | None = None, **settings) -> DataFrame:
    """Sparse citation counts of the patents cited often enough; only of a sample of them if ``sampling`` names one."""
    counts = durable(citation_counts(facts, mode))
    kept = cited_totals(counts, min_citations)
    if sampling is not None:
        kept = sample_patents(kept, sampling, **settings)
    return counts.join(kept.select("entity"), "entity", "left_semi")


def cumulative_citations(facts: DataFrame, mode: str = "month", min_citations: int = 2, **sampling) -> DataFrame:
    """Running citation count of each kept patent over every bin."""
    return cumulate(durable(kept_counts(facts, mode, min_citations, **sampling))).select("entity", "bin", "cum")


def keep_top_cited(facts: DataFrame, n: int) -> DataFrame:
    """Facts of the ``n`` most cited patents (ties by id); ``n <= 0`` keeps all."""
    if n <= 0:
        return facts
    top = facts.groupBy("head").agg(F.count(F.lit(1)).alias("_c")).orderBy(F.desc("_c"), "head").limit(n)
    return facts.join(top.select("head"), "head", "left_semi")
