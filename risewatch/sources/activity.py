"""Count payloads of the activity collectors to activity records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where each kind of answer keeps its total.
COUNT_PATHS = {
    "crossref": "$.message.total-results",
    "odp": "$.queryStatus.totalResults",
    "patentsearch": "$.total_patent_count",
}


def counts_from_payload(df: DataFrame, kind: str) -> DataFrame:
    """One record per (topic, window): ``ok`` with a count (0 when the total is missing) or ``failed`` without.

    ``df`` has ``source, topic_id, topic_label, window_start, window_end, payload, error``. An error or a body
    that is not of the expected format is a failure.
    """
    if kind == "arxiv":
        total = F.regexp_extract("payload", r"<(?:\w+:)?totalResults[^>]*>\s*(\d+)\s*<", 1).try_cast("bigint")
        parsed = F.col("payload").isNotNull()
    else:
        parsed = F.try_parse_json("payload").isNotNull() & F.col("payload").rlike(r"^\s*\{")
        total = F.get_json_object("payload", COUNT_PATHS[kind].replace("total-results", "['total-results']").replace(".[", "["))
        total = total.try_cast("bigint")
    ok = F.col("error").isNull() & parsed
    return df.select(
        "source",
        "topic_id",
        "topic_label",
        "window_start",
        "window_end",
        F.when(ok, F.coalesce(total, F.lit(0))).alias("activity_count"),
        F.when(ok, "ok").otherwise("failed").alias("collection_status"),
        F.when(~ok, F.coalesce("error", F.concat(F.lit("non-JSON response: "), "payload"))).alias("error"),
    )
