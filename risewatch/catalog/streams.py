"""Streaming queries, run to completion over the driver's event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from risewatch.catalog.registry import query
from risewatch.operators.activity import API_FAILURE, SUDDEN_DROP
from risewatch.streaming import incremental as I
from risewatch.streaming import runs, tags
from risewatch.streaming.store import IdStore

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark, d):
    raw = I.ingest_stream(spark, d, EVENTS, "parquet", pathGlobFilter="events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "str_03_daily_counts",
    """SELECT strftime(ts, '%Y-%m-%d') AS bin, event_type AS entity, count(*) AS cnt FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""",
)
def _(spark, d):
    sink = I.stream_folder(spark, "daily-counts")
    I.run_available(I.count_stream(events(spark, d), "event_type"), sink, I.stream_folder(spark, "daily-counts-log"))
    return spark.read.parquet(sink)


@query(
    "str_02_dedup",
    """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events GROUP BY 1, 2""",
)
def _(spark, d):
    sink = I.stream_folder(spark, "dedup")
    ident = F.concat_ws("|", "user_id", F.date_format("ts", "yyyy-MM-dd"))
    rows = I.dedup_stream(events(spark, d).withColumn("id", ident), delay="31 days")
    I.run_available(
        rows.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")), sink, I.stream_folder(spark, "dedup-log")
    )
    return spark.read.parquet(sink)




#: The days that arrive before the first, second and third run; an idle run follows the second.
ARRIVALS = ("2024-01-11", "2024-01-21", "9999")


def arrivals(spark, d, *columns):
    """The events as files of a folder that grows from run to run: yields the stream over it after each arrival."""
    folder, since = I.stream_folder(spark, "arrivals"), ""
    day = F.date_format("ts", "yyyy-MM-dd")
    source = spark.read.schema(EVENTS).parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select(*columns, day.alias("day"))
    for until in ARRIVALS:
        source.where((F.col("day") >= since) & (F.col("day") < until)).write.mode("append").parquet(folder)
        since = until
        yield I.ingest_stream(spark, folder, source.schema, "parquet")


@query("str_01_resumed_ingest", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def _(spark, d):
    """Three runs over a growing folder, each resuming where the last one stopped."""
    sink, log = I.stream_folder(spark, "ingested"), I.stream_folder(spark, "ingest-log")
    for stream in arrivals(spark, d, "event_id"):
        I.run_available(stream, sink, log)
    return spark.read.parquet(sink).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "str_02_exactly_once",
    """SELECT user_id || '|' || event_type AS id, min(event_id) AS event_id,
      CASE WHEN min(strftime(ts, '%Y-%m-%d')) < '2024-01-11' THEN 0 WHEN min(strftime(ts, '%Y-%m-%d')) < '2024-01-21' THEN 1 ELSE 2 END::BIGINT AS batch FROM events GROUP BY 1""",
)
def _(spark, d):
    """The first event of each user and type over three runs, whatever its age."""
    store, log = IdStore(spark, I.stream_folder(spark, "id-store"), buckets=64), I.stream_folder(spark, "id-log")
    ident = F.concat_ws("|", "user_id", "event_type").alias("id")
    for stream in arrivals(spark, d, "event_id", ident):
        stream.select("id", "event_id").writeStream.foreachBatch(store.sink("event_id")).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return store.rows("id string, event_id bigint, batch bigint")


@query(
    "str_05_run_manifest",
    """WITH told AS (SELECT *, CASE WHEN strftime(ts, '%Y-%m-%d') < '2024-01-11' THEN 0 WHEN strftime(ts, '%Y-%m-%d') < '2024-01-21' THEN 1 ELSE 3 END::BIGINT AS run_id FROM events),
    per AS (SELECT run_id, event_type AS source, count(*) FILTER (value < 400) AS n, max(value) AS most FROM told GROUP BY 1, 2)
    SELECT run_id, source, n, false AS noop, CASE WHEN max(most) OVER (PARTITION BY run_id) >= 400 THEN 'error' ELSE 'ok' END AS status FROM per
    UNION ALL SELECT 2, NULL, NULL, true, 'ok'""",
)
def _(spark, d):
    """Four runs, the third over an unchanged folder; events of 400 and more stand for failed records."""
    path, sink = I.stream_folder(spark, "runs"), I.stream_folder(spark, "run-rows")
    write = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
    error = F.when(F.col("value") >= 400, "too large")
    for i, stream in enumerate(arrivals(spark, d, "event_id", F.col("event_type").alias("source"), "value")):
        for _ in range(1 + (i == 1)):
            runs.run_once(stream.withColumn("error", error), path, write)
    return runs.read_manifest(spark, path).select("run_id", F.explode_outer("new_records").alias("source", "n"), "noop", "status")


@query(
    "str_06_online_tags",
    f"""WITH rows AS (SELECT event_type AS topic_id, (user_id % 7)::VARCHAR AS source, strftime(ts, '%Y-%m-%d') || ' ' || lpad(event_id::VARCHAR, 12, '0') AS window_start,
      greatest(0, floor(value / 10) - 3)::DOUBLE AS value FROM events),
    isles AS (SELECT *, sum((value <> 0)::INT) OVER w AS z, coalesce(sum((value <= 0)::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p
      FROM rows WINDOW w AS (PARTITION BY topic_id, source ORDER BY window_start)),
    runs AS (SELECT *, count(*) FILTER (value = 0) OVER (PARTITION BY topic_id, source, z) AS zeros,
      count(*) FILTER (value > 0) OVER (PARTITION BY topic_id, source, p ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS positives FROM isles)
    SELECT topic_id, source, window_start, value, '{API_FAILURE}' AS tag FROM runs WHERE value = 0 AND zeros >= 3
    UNION ALL SELECT topic_id, source, window_start, value, '{SUDDEN_DROP}' FROM runs WHERE value <= 0 AND positives >= 3""",
)
def _(spark, d):
    """Tags of three runs with the state carried between them, equal to the batch tags of all rows."""
    found, side, log = (I.stream_folder(spark, n) for n in ("tags", "tags-aside", "tags-log"))
    start = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    value = F.greatest(F.lit(0), F.floor(F.col("value") / 10) - 3).cast("double")
    source = F.pmod("user_id", F.lit(7)).cast("string")
    for stream in arrivals(spark, d, F.col("event_type").alias("topic_id"), source.alias("source"), start.alias("window_start"), value.alias("value")):
        tags.run_tags(stream, found, side, log)
    return tags.read_tags(spark, found).drop("batch")
