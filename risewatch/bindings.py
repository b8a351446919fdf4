"""The driver tables seen as this engine's inputs. All bindings are row-wise or plain joins; none gathers groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risewatch.operators.core import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def iso(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def with_orders(spark: SparkSession, folder: str, lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines joined with their orders, the tasks as many as the lines ask for."""
    rows = table(spark, folder, "lineitem").count()  # from the file footers
    return spread(lines, rows, "l_orderkey").join(spread(orders, rows, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per concept mention of a document: order lines with the part name as the concept."""
    o = table(spark, folder, "orders").select("o_orderkey", iso("o_orderdate").alias("time"))
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_linenumber")
    p = table(spark, folder, "part").select("p_partkey", F.col("p_name").alias("entity"))
    return (
        with_orders(spark, folder, l, o)
        .join(p, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_orderkey").alias("doc_id"),
            "entity",
            "time",
            F.col("l_extendedprice").alias("score"),
            F.col("l_linenumber").alias("pos"),
        )
    )


def concept_triples(spark: SparkSession, folder: str) -> DataFrame:
    """Document-concept quads."""
    return mentions(spark, folder).select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("head"),
        F.lit("Paper").alias("head_type"),
        F.lit("belongs_to").alias("relation"),
        F.col("entity").alias("tail"),
        F.lit("Concept").alias("tail_type"),
        "time",
        F.lit("orders").alias("source"),
    )


def backward_citations(spark: SparkSession, folder: str) -> DataFrame:
    """A part cited by an order at the order date."""
    o = table(spark, folder, "orders").select("o_orderkey", iso("o_orderdate").alias("citing_date"))
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    return with_orders(spark, folder, l, o).select(
        F.col("l_orderkey").cast("string").alias("citing"),
        "citing_date",
        F.col("l_partkey").cast("string").alias("cited"),
        F.lit(None).cast("string").alias("cited_date"),
    )


def directed(spark: SparkSession, folder: str) -> DataFrame:
    """Nation-to-nation edges with a relation taken from the order priority."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", iso("o_orderdate").alias("time"))
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    head = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("head"))
    tail = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("tail"))
    digit = F.substring("o_orderpriority", 1, 1)
    relation = (
        F.when(digit == "1", "uses")
        .when(digit == "2", "improves")
        .when(digit == "3", "compares")
        .when(digit == "4", "targets")
        .otherwise("competes")
    )
    # orders meet their customers and lines their suppliers first, so that only narrow rows meet by order
    placed = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", relation.alias("relation"), "time", "c_nationkey")
    supplied = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    return (
        with_orders(spark, folder, supplied, placed)
        .join(head, "s_nationkey")
        .join(tail, "c_nationkey")
        .select(
            "head",
            F.lit("Concept").alias("head_type"),
            "relation",
            "tail",
            F.lit("Concept").alias("tail_type"),
            "time",
            F.lit("orders").alias("source"),
        )
    )


def works(spark: SparkSession, folder: str) -> DataFrame:
    """One nested work per order, every array built from the columns of its own row."""
    o = table(spark, folder, "orders")
    c = table(spark, folder, "customer")
    n = table(spark, folder, "nation")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey")
    year = F.date_format("o_orderdate", "yyyy")

    def concept(id_, name, score):
        return F.struct(
            F.concat(F.lit("u/"), id_).alias("id"), name.alias("name"), score.cast("double").alias("score")
        )

    concepts = F.array(
        concept(F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)), F.col("o_orderpriority"), F.col("o_totalprice") / 1e6),
        concept(F.concat(F.lit("S"), F.col("o_orderstatus")), F.concat(F.lit("status "), F.col("o_orderstatus")), F.lit(0.5)),
        concept(F.concat(F.lit("M"), F.col("c_mktsegment")), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 7 != 0, F.lit(0.3))),
        concept(F.concat(F.lit("N"), F.col("n_name")), F.col("n_name"), (key % 10) / 10.0),
        concept(F.concat(F.lit("R"), F.col("n_regionkey")), F.concat(F.lit("region "), F.col("n_regionkey")), F.lit(0.5)),
        concept(F.concat(F.lit("Y"), year), year, F.lit(0.05)),
    )
    person = lambda k: F.concat(F.lit("u/A"), k.cast("string"))
    place = lambda p, k: F.struct(F.concat(F.lit(p), k.cast("string")).alias("id"), F.concat(F.lit("site "), F.lit(p), k.cast("string")).alias("name"))
    author = lambda k, places: F.struct(
        F.struct(person(k).alias("id"), F.concat(F.lit("person "), k.cast("string")).alias("name")).alias("author"),
        places.alias("institutions"),
    )
    none = F.array().cast("array<struct<id:string,name:string>>")
    refs = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: key >= i),
        lambda i: F.concat(F.lit("https://works.example/W"), (key - i).cast("string")),
    )
    return j.select(
        F.concat(F.lit("https://works.example/W"), key.cast("string")).alias("id"),
        F.lit("openalex").alias("source"),
        F.concat(F.lit("title "), key.cast("string")).alias("title"),
        F.when(key % 5 == 0, F.concat(F.lit("10.1/ABC."), key.cast("string"), F.lit("."))).alias("doi"),
        iso("o_orderdate").alias("publication_date"),
        F.lit(None).cast("string").alias("abstract"),
        F.when(key % 3 != 0, key % 100).alias("cited_by_count"),
        concepts.alias("concepts"),
        F.array(
            author(F.col("o_custkey"), F.array(place("u/I", F.col("c_nationkey")), place("u/J", F.col("n_regionkey")))),
            author(F.col("o_custkey") + 1, none),
        ).alias("authorships"),
        refs.alias("referenced_works"),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Activity records per (topic, day, source) counted from the event stream."""
    k = F.regexp_replace("props", "[^0-9]", "").try_cast("int")
    m = F.col("user_id") % 6
    source = (
        F.when(m == 0, "openalex").when(m == 1, "crossref").when(m == 2, "arxiv")
        .when(m == 3, "uspto").when(m == 4, "gdelt").otherwise("github")
    )
    e = table(spark, folder, "events").select(
        source.alias("source"),
        F.col("event_type").alias("topic_id"),
        F.upper("event_type").alias("topic_label"),
        iso("ts").alias("window_start"),
        iso("ts").alias("window_end"),
        F.when(k % 17 == 0, "failed").otherwise("ok").alias("collection_status"),
    )
    keys = ["source", "topic_id", "topic_label", "window_start", "window_end", "collection_status"]
    n = F.count(F.lit(1))
    return e.groupBy(*keys).agg(
        F.when((F.col("collection_status") == "ok"), n).alias("activity_count"),
        F.when(F.col("collection_status") == "failed", F.concat(F.lit("error "), (n % 3).cast("string"))).alias("error"),
    )


def day_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Window catalogue of the activity checks: every day from the first event to five days after the last."""
    day = F.to_date("ts")
    span = table(spark, folder, "events").agg(F.min(day).alias("a"), F.date_add(F.max(day), 5).alias("b"))
    days = F.sequence("a", "b", F.expr("interval 1 day"))
    return span.where("a is not null").select(F.explode(days).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("window_start"))


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Repository signals from the event stream: one repository per user and topic."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("repo_id"),
        F.col("event_type").alias("topic_id"),
        iso("ts").alias("created_at"),
        F.floor("value").cast("bigint").alias("stars_total"),
        F.round(F.col("value") / 7, 3).alias("stars_per_day_lifetime"),
        (F.col("user_id") % 9).alias("forks_total"),
        F.when(F.col("value") > 100, 1).otherwise(0).alias("activity_recent"),
    )


def name_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Anchored concepts (distinct part names) and name-only variants of every part."""
    p = table(spark, folder, "part")
    anchors = p.select("p_name").distinct().select(
        F.concat(F.lit("C:"), "p_name").alias("id"),
        F.lit("Concept").alias("type"),
        F.concat(F.lit("C:"), "p_name").alias("entity_id"),
        F.col("p_name").alias("name"),
        F.lit("openalex").alias("source"),
        F.lit(None).cast("string").alias("doi"),
    )
    variants = p.select("p_partkey", "p_name").select(
        F.explode(
            F.array(
                F.struct(F.lit("u").alias("v"), F.lit("Technology").alias("type"), F.upper("p_name").alias("name")),
                F.struct(F.lit("d").alias("v"), F.lit("Method").alias("type"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")).alias("name")),
                F.struct(F.lit("s").alias("v"), F.lit("Model").alias("type"), F.concat("p_name", F.lit("s")).alias("name")),
                F.struct(F.lit("z").alias("v"), F.lit("Dataset").alias("type"), F.concat(F.lit("zz "), F.substring("p_name", 1, 2)).alias("name")),
                F.struct(F.lit("f").alias("v"), F.lit("Person").alias("type"), F.col("p_name").alias("name")),
            )
        ).alias("e"),
        "p_partkey",
    ).select(
        F.concat("e.v", F.lit(":"), F.col("p_partkey").cast("string")).alias("id"),
        "e.type",
        F.lit(None).cast("string").alias("entity_id"),
        "e.name",
        F.lit("uspto").alias("source"),
        F.lit(None).cast("string").alias("doi"),
    )
    return anchors.unionByName(variants)
