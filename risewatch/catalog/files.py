"""Queries over file sources and sinks: files are written from every row of the driver tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from risewatch import bindings as B
from risewatch.catalog.graphs import LINK_BT
from risewatch.catalog.payloads import DAY, orders
from risewatch.catalog.registry import DIRECTED, query
from risewatch.catalog.series import r6
from risewatch.functions.text import decode_entities
from risewatch.operators.resolve import indel_similarity
from risewatch.plans import backtest
from risewatch.session import durable
from risewatch.sources import files, news, patents, repos, scholarly
from risewatch.streaming.incremental import stream_folder


def say(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


@query("src_01_jsonl_scan", f"SELECT o_orderkey::BIGINT AS id, o_orderpriority AS topic, {DAY} AS day FROM orders UNION ALL SELECT -1, NULL, NULL")
def _(spark, d):
    """JSON lines with blank lines between, one line without the optional fields, and a folder that is not there."""
    folder, schema = stream_folder(spark, "jsonl"), "id bigint, topic string, day string"
    line = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("topic"), "day", F.lit(1).alias("unknown")))
    orders(spark, d).select(F.explode(F.array(line, F.lit(""))).alias("value")).write.text(f"{folder}/a")
    spark.createDataFrame([('{"id": -1}',)], "value string").write.text(f"{folder}/b")
    return files.read_jsonl(spark, f"{folder}/*", schema).unionByName(files.read_jsonl(spark, f"{folder}-absent", schema))


FEED = """DOI string, title array<string>, `container-title` array<string>, published struct<`date-parts`:array<array<int>>>, issued struct<`date-parts`:array<array<int>>>,
created struct<`date-parts`:array<array<int>>>, abstract string, subject array<string>, author array<struct<given:string,family:string>>, reference array<struct<DOI:string>>"""


@query(
    "src_04_works_from_doi_feed",
    f"""SELECT 'doi:10.1/ab' || o_orderkey AS id, 'crossref' AS source, CASE WHEN o_orderkey % 2 = 0 THEN 'title ' ELSE 'journal ' END || o_orderkey AS title, '10.1/AB' || o_orderkey AS doi,
      CASE WHEN o_orderkey % 3 = 0 THEN substr({DAY}, 1, 7) ELSE {DAY} END AS publication_date, 'a & b' AS abstract, 'crossref:' || o_orderpriority AS concept_id, o_orderpriority AS concept,
      'Ann P' || o_custkey AS author, '10.1/r' AS reference FROM orders""",
)
def _(spark, d):
    o = orders(spark, d)
    part = lambda i: F.split("day", "-")[i].cast("int")
    date = F.array(F.when(F.col("o_orderkey") % 3 == 0, F.array(part(0), part(1))).otherwise(F.array(part(0), part(1), part(2))))
    even = F.col("o_orderkey") % 2 == 0
    item = F.to_json(
        F.struct(
            say(" 10.1/AB", F.col("k"), " ").alias("DOI"), F.when(even, F.array(say("title ", F.col("k")))).otherwise(F.array().cast("array<string>")).alias("title"),
            F.array(say("journal ", F.col("k"))).alias("container-title"), F.when(even, F.struct(date.alias("date-parts"))).alias("published"), F.struct(date.alias("date-parts")).alias("issued"),
            F.lit("<jats:p>a &amp; b</jats:p>").alias("abstract"), F.array(F.col("o_orderpriority"), F.lit("")).alias("subject"),
            F.array(F.struct(F.lit("Ann").alias("given"), say("P", F.col("o_custkey").cast("string")).alias("family"))).alias("author"),
            F.array(F.struct(F.lit("10.1/r").alias("DOI")), F.struct(F.lit("").alias("DOI"))).alias("reference"),
        )
    )
    works = scholarly.normalize_crossref(o.select(F.from_json(item, FEED).alias("w")).select("w.*"))
    return works.select(
        "id", "source", "title", "doi", "publication_date", "abstract", F.get("concepts.id", F.lit(0)).alias("concept_id"), F.get("concepts.name", F.lit(0)).alias("concept"),
        F.get("authorships.author.name", F.lit(0)).alias("author"), F.get("referenced_works", F.lit(0)).alias("reference"),
    )


def patent_files(spark, d):
    """Patent documents, many to a file; every tenth is cut short and not well formed."""
    k, cust = F.col("k"), F.col("o_custkey").cast("string")
    body = say(
        '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE us-patent-grant SYSTEM "grant.dtd" [ ]>\n<us-patent-grant><biblio><publication-reference><document-id><country>US</country><doc-number>', k,
        "</doc-number><kind>B2</kind><date>", F.regexp_replace("day", "-", ""), "</date></document-id></publication-reference><classifications-cpc><classification-cpc><section>G</section>",
        "<class>06</class><subclass>N</subclass></classification-cpc></classifications-cpc><invention-title id='t'>Order &amp; ", k, "</invention-title><us-references-cited><us-citation><patcit>",
        "<document-id><country>US</country><doc-number>", cust, "</doc-number><date>19990101</date></document-id></patcit></us-citation><us-citation><patcit><document-id><country>DE</country>",
        "<doc-number>1</doc-number></document-id></patcit></us-citation></us-references-cited><assignees><assignee><addressbook><orgname>Org ", F.col("o_orderstatus"), "</orgname></addressbook></assignee>",
        "</assignees><inventors><inventor><addressbook><last-name>L", cust, "</last-name><first-name>Ann</first-name></addressbook></inventor></inventors></biblio><abstract id='a'><p id='p'>About ",
        F.col("o_orderpriority"), "</p><p>more</p></abstract>", F.when(F.col("o_orderkey") % 10 != 0, "</us-patent-grant>").otherwise(""), "\n",
    )
    folder = stream_folder(spark, "patents")
    # compressed, as the bulk files are; a compressed file is read by one task, so each holds a bounded number of documents
    orders(spark, d).select(body.alias("value")).write.option("maxRecordsPerFile", 100_000).text(folder, compression="gzip")
    return durable(patents.read_concat_xml(spark, f"{folder}/*.txt.gz"))


@query("src_07_patent_documents", "SELECT o_orderkey::VARCHAR AS number, true AS bare FROM orders WHERE o_orderkey % 10 <> 0")
def _(spark, d):
    number = F.regexp_extract("xml", "<doc-number>([^<]*)<", 1)
    return patent_files(spark, d).select(number.alias("number"), (~F.col("xml").contains("DOCTYPE") & ~F.col("xml").contains("<?xml")).alias("bare"))


@query(
    "src_08_patent_biblio",
    f"""SELECT 'uspto:' || o_orderkey AS id, 'Order & ' || o_orderkey AS title, 'About ' || o_orderpriority || ' more' AS abstract, 'Org ' || o_orderstatus AS assignee, 'Ann L' || o_custkey AS inventor,
      {DAY} AS publication_date, 'G06N' AS cpc, 'B2' AS kind FROM orders WHERE o_orderkey % 10 <> 0""",
)
def _(spark, d):
    first = lambda c: F.array_join(c, "|")
    rows = patents.parse_patent_biblio(patent_files(spark, d))
    return rows.select("id", "title", "abstract", first("assignees").alias("assignee"), first("inventors").alias("inventor"), "publication_date", first("cpc").alias("cpc"), "kind")


@query(
    "src_10_patent_citations",
    f"SELECT 'uspto:' || o_orderkey AS citing, {DAY} AS citing_date, 'uspto:' || o_custkey AS cited, '19990101' AS cited_date FROM orders WHERE o_orderkey % 10 <> 0",
)
def _(spark, d):
    return patents.patent_backward_citations(patent_files(spark, d))


@query(
    "src_13_citation_csv",
    f"SELECT 'uspto:' || o_custkey AS citing, {DAY} AS citing_date, 'uspto:' || o_orderkey AS cited, '1990-01-01' AS cited_date FROM orders WHERE o_orderkey % 7 <> 0",
)
def _(spark, d):
    folder = stream_folder(spark, "citations")
    blank = F.when(F.col("o_orderkey") % 7 != 0, say(" ", F.col("o_custkey").cast("string"), " ")).otherwise(" ")
    rows = orders(spark, d).select(F.col("k").alias("doc"), blank.alias("by"), F.col("day").alias("on"), F.lit("1990-01-01").alias("from"))
    rows.write.option("header", True).csv(folder)
    return patents.citations_from_csv(spark.read.option("header", True).csv(folder), "doc", "by", "on", "from")


@query(
    "src_18_timeline_months",
    """WITH m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS w FROM orders UNION SELECT '1990-01'), t AS (SELECT DISTINCT o_orderpriority AS topic_id FROM orders)
    SELECT t.topic_id, m.w AS window_start, count(o.o_orderkey) AS activity_count FROM t CROSS JOIN m
    LEFT JOIN orders o ON o.o_orderpriority = t.topic_id AND strftime(o.o_orderdate, '%Y-%m') = m.w GROUP BY 1, 2""",
)
def _(spark, d):
    o = orders(spark, d)
    days = o.groupBy("o_orderpriority", "day").agg(F.count(F.lit(1)).alias("n"))  # calendar days of five topics
    stamp = say(F.regexp_replace("day", "-", ""), "T000000Z")
    entry = F.when(F.substring("day", 9, 2) < "15", F.create_map(F.lit("date"), stamp, F.lit("value"), F.col("n").cast("string"))).otherwise(F.create_map(stamp, F.col("n").cast("string")))
    payload = F.to_json(F.struct(F.array(F.create_map(F.lit("series"), F.lit("x")), F.create_map(F.lit("data"), F.to_json(F.collect_list(entry)))).alias("timeline")))
    payloads = days.groupBy(F.col("o_orderpriority").alias("topic_id")).agg(payload.alias("payload")).withColumn("topic_label", F.col("topic_id"))
    months = o.select(F.substring("day", 1, 7).alias("window_start")).distinct().unionByName(spark.createDataFrame([("1990-01",)], "window_start string"))
    return news.timeline_monthly(payloads, months.withColumn("window_end", F.col("window_start"))).select("topic_id", "window_start", "activity_count")


@query(
    "src_20_repo_signals",
    """WITH r AS (SELECT *, (o_orderkey % 1000)::BIGINT AS stars FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_custkey % 5 <> 0),
    b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY stars DESC, o_orderkey) = 1)
    SELECT o_orderpriority AS topic_id, o_custkey::BIGINT AS repo_id, o_orderkey::VARCHAR AS full_name, stars AS stars_total,
      round(stars / greatest(1, date_diff('day', o_orderdate, DATE '1998-12-31'))::DOUBLE, 3) AS stars_per_day_lifetime, (o_custkey % 31 >= 27)::INT AS activity_recent FROM b""",
)
def _(spark, d):
    o = orders(spark, d)
    raw = o.select(
        F.col("o_custkey").alias("id"), F.col("k").alias("full_name"), (F.col("o_orderkey") % 1000).alias("stargazers_count"), F.lit(2).cast("bigint").alias("forks_count"),
        F.col("o_orderstatus").alias("language"), F.struct((F.col("o_custkey") % 5 != 0).cast("string").alias("login")).alias("owner"), F.col("day").alias("created_at"),
        say("1998-12-", F.lpad((F.col("o_custkey") % 31 + 1).cast("string"), 2, "0")).alias("pushed_at"), F.col("o_orderpriority").alias("topic_id"), F.col("o_orderpriority").alias("topic_label"),
        F.lit("w").alias("_window"), F.col("o_orderkey").alias("fetched_seq"),
    )
    return repos.repo_signals(raw, "1998-12-31", ("O", "F"), ("true",)).select(
        "topic_id", F.col("repo_id").cast("bigint").alias("repo_id"), "full_name", "stars_total", "stars_per_day_lifetime", "activity_recent"
    )


@query("snk_01_jsonl_round_trip", f"SELECT o_orderkey::BIGINT AS id, {DAY} AS day, false AS empty FROM orders UNION ALL SELECT o_orderkey::BIGINT, {DAY}, true FROM orders")
def _(spark, d):
    folder = stream_folder(spark, "jsonl-sink")
    rows = orders(spark, d).select(F.col("o_orderkey").alias("id"), "day", F.lit("x").alias("note"))
    files.write_jsonl(rows.where("false"), folder)
    files.write_jsonl(rows, folder)
    files.write_jsonl(rows.withColumn("note", F.lit(None).cast("string")), folder, "append")
    return files.read_jsonl(spark, folder, "id bigint, day string, note string").select("id", "day", F.col("note").isNull().alias("empty"))


@query(
    "snk_02_csv_round_trip",
    f"""SELECT o_orderpriority || ', "quoted"' AS topic, substr({DAY}, 1, 7) AS month, count(*) AS n FROM orders GROUP BY 1, 2""",
)
def _(spark, d):
    folder = stream_folder(spark, "csv-sink")
    table = orders(spark, d).groupBy(say(F.col("o_orderpriority"), ', "quoted"').alias("topic"), F.substring("day", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    files.write_csv(table, folder)
    return spark.read.schema("topic string, month string, n bigint").option("header", True).option("escape", "\\").csv(folder)


@query(
    "snk_04_raw_snapshots",
    f"""SELECT o_orderstatus AS source, '2024-01-01' AS run_date, count(*) AS n, 'first' AS kind FROM orders GROUP BY 1
    UNION ALL SELECT o_orderstatus, '2024-01-02', count(*), 'again' FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1""",
)
def _(spark, d):
    """Two days of three sources; the second day is run twice and only its own partition is replaced."""
    root = stream_folder(spark, "raw")
    for state in ("F", "O", "P"):
        rows = orders(spark, d).where(F.col("o_orderstatus") == state).select("k", "o_orderkey")
        files.write_raw(rows.withColumn("kind", F.lit("first")), root, state, "2024-01-01")
        files.write_raw(rows.withColumn("kind", F.lit("first")), root, state, "2024-01-02")
        files.write_raw(rows.where("o_orderkey % 2 = 0").withColumn("kind", F.lit("again")), root, state, "2024-01-02")
    return spark.read.parquet(root).groupBy("source", F.col("run_date").cast("string").alias("run_date"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query("bt_05_edge_fallback", f"WITH {DIRECTED}, {LINK_BT.replace('SELECT s.*,', "SELECT 'cooccur' AS edges, s.*,")}")
def _(spark, d):
    """The chosen edges (those of one month) give no fold, so the fallback edges are used."""
    f = durable(B.directed(spark, d).select("head", "relation", "tail", "time"))
    rows, used, _ = backtest.backtest_links_with_fallback(f.where("time < '1992-02'"), f)
    return rows.select(F.lit(used).alias("edges"), "fold", "n_train", "n_test", "train_end", "test_start", "test_end", *[r6(c) for c in ("mrr", "hits_at_1", "hits_at_3", "hits_at_10")])


@query(
    "udf_01_indel_similarity",
    "SELECT p_partkey::BIGINT AS id, round(2.0 * (length(p_name) - p_partkey % 5) / (2 * length(p_name) - p_partkey % 5), 6)::DOUBLE AS score FROM part",
)
def _(spark, d):
    """A name against itself without its first letters: their longest common subsequence is known."""
    tail = F.substring("p_name", (F.col("p_partkey") % 5 + 1).cast("int"), F.length("p_name"))
    return B.table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("id"), F.round(indel_similarity("p_name", tail), 6).alias("score"))


@query("udf_02_decoded_entities", "SELECT c_custkey::BIGINT AS id, c_name || ' & <' || chr((65 + c_custkey % 26)::INT) || 'é>' AS text FROM customer")
def _(spark, d):
    raw = say(F.col("c_name"), " &amp; &lt;&#", (65 + F.col("c_custkey") % 26).cast("string"), ";&eacute;&#x3E;")
    return B.table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), decode_entities(raw).alias("text"))
