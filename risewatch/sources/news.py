"""News: tab-separated event files, feed items, and volume timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risewatch.functions.text import blank_to_null, plain_summary, split_counts

# Column positions of the event file and its header mark.
COL_ID, COL_DATE, COL_THEMES, COL_PERSONS, COL_ORGS, COL_TONE = 0, 1, 8, 12, 14, 15
HEADER_MARK = "GKGRECORDID"


def read_gkg(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines; invalid bytes become replacement characters."""
    return spark.read.text(path)


def normalize_gkg(raw: DataFrame, themes: Sequence[str] = ()) -> DataFrame:
    """Event lines to news rows; header and short lines dropped, optional theme filter."""
    f = F.split("value", "\t", -1)
    cells = raw.select(f.alias("f")).where((F.size("f") > COL_TONE) & (F.col("f")[COL_ID] != HEADER_MARK))
    at = lambda i: F.col("f")[i]
    date = at(COL_DATE)
    iso = F.concat_ws("-", F.substring(date, 1, 4), F.substring(date, 5, 2), F.substring(date, 7, 2))
    rows = cells.select(
        F.concat(F.lit("gdelt:"), at(COL_ID)).alias("id"),
        F.lit("gdelt").alias("source"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("url"),
        split_counts(at(COL_THEMES)).alias("themes"),
        split_counts(at(COL_PERSONS)).alias("persons"),
        split_counts(at(COL_ORGS)).alias("organizations"),
        F.split(at(COL_TONE), ",")[0].try_cast("double").alias("tone"),
        F.when(F.length(date) >= 8, iso).otherwise(date).alias("publication_date"),
    )

    def labelled(label: str, c: str) -> Column:
        return F.when(F.size(c) > 0, F.concat(F.lit(f"{label}:"), F.array_join(c, ", ")))

    rows = rows.withColumn(
        "text",
        F.concat_ws(" ", labelled("themes", "themes"), labelled("persons", "persons"), labelled("orgs", "organizations")),
    )
    if themes:
        rows = rows.where(F.arrays_overlap("themes", F.array(*[F.lit(t) for t in themes])))
    return rows


def feed_date(c: Column) -> Column:
    """RFC 822 day to ISO, else the first ten characters."""
    day = F.regexp_extract(c, r"(\d{1,2} [A-Za-z]{3} \d{4})", 1)
    parsed = F.date_format(F.try_to_date(blank_to_null(day), "d MMM yyyy"), "yyyy-MM-dd")
    return F.coalesce(parsed, F.substring(c, 1, 10))


def normalize_rss(raw: DataFrame) -> DataFrame:
    """Feed items to news rows with plain text."""
    published = F.coalesce(blank_to_null(F.col("published")), F.col("updated"), F.lit(""))
    link = F.coalesce("link", F.lit(""))
    none = F.array().cast("array<string>")
    return raw.select(
        F.concat(F.lit("rsshub:"), link).alias("id"),
        F.lit("rsshub").alias("source"),
        F.trim(F.coalesce("title", F.lit(""))).alias("title"),
        plain_summary(F.col("summary")).alias("text"),
        link.alias("url"),
        none.alias("themes"),
        none.alias("persons"),
        none.alias("organizations"),
        F.lit(None).cast("double").alias("tone"),
        feed_date(published).alias("publication_date"),
    )


def timeline_monthly(payloads: DataFrame, windows: DataFrame) -> DataFrame:
    """Monthly news volume per topic from timeline payloads; a month without data is 0.

    ``payloads`` has ``topic_id, topic_label, payload``; the first series that holds data counts. An entry is
    ``{date, value}`` or ``{<date>: n}``.
    """
    series = F.filter(
        F.from_json("payload", "timeline array<map<string,string>>")["timeline"], lambda s: F.map_contains_key(s, "data")
    )
    data = F.from_json(F.get(series, F.lit(0))["data"], "array<map<string,string>>")
    plain = lambda e: F.map_contains_key(e, "date") & F.map_contains_key(e, "value")
    other = lambda e: F.get(
        F.filter(F.map_entries(e), lambda kv: kv["value"].try_cast("double").isNotNull()), F.lit(0)
    )
    entry = lambda e: F.struct(
        F.when(plain(e), e["date"]).otherwise(other(e)["key"]).alias("date"),
        F.when(plain(e), e["value"]).otherwise(other(e)["value"]).try_cast("double").cast("bigint").alias("n"),
    )
    points = payloads.select("topic_id", "topic_label", F.explode(F.transform(data, entry)).alias("p")).select(
        "topic_id", "topic_label", "p.date", "p.n"
    )
    day = F.split("date", "T")[0]
    monthly = (
        points.where(day.rlike(r"^\d{6}"))
        .groupBy("topic_id", F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2)).alias("window_start"))
        .agg(F.sum("n").alias("n"))
    )
    span = windows.agg(F.array_sort(F.collect_list(F.struct("window_start", "window_end"))).alias("_w"))
    grid = (
        payloads.select("topic_id", "topic_label").distinct()
        .withColumn("_w", span.scalar())
        .select("topic_id", "topic_label", F.inline("_w"))
    )
    return grid.join(monthly, ["topic_id", "window_start"], "left").select(
        F.lit("gdelt").alias("source"),
        "topic_id",
        "topic_label",
        "window_start",
        "window_end",
        F.coalesce("n", F.lit(0)).alias("activity_count"),
        F.lit("ok").alias("collection_status"),
    )
