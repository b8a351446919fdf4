"""Queries over the parsers: raw payloads are built from every row of the driver tables, then parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from risewatch import bindings as B
from risewatch.catalog.registry import query
from risewatch.functions import text
from risewatch.operators import extract as X
from risewatch.sources import activity as A
from risewatch.sources import news as N
from risewatch.sources import repos as R
from risewatch.sources import scholarly as S
from risewatch.streaming import incremental as I

DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def orders(spark, d):
    return B.table(spark, d, "orders").withColumn("day", B.iso("o_orderdate")).withColumn("k", F.col("o_orderkey").cast("string"))


WORK = """id string, title string, doi string, publication_date string, abstract_inverted_index map<string,array<int>>, cited_by_count bigint,
concepts array<struct<id:string,display_name:string,score:double>>,
authorships array<struct<author:struct<id:string,display_name:string>,institutions:array<struct<id:string,display_name:string>>>>, referenced_works array<string>"""


@query(
    "src_02_works_from_pages",
    f"""SELECT 'w/W' || o_orderkey AS id, 'openalex' AS source, 'title ' || o_orderkey AS title, {DAY} AS publication_date, 'order ' || o_orderpriority || ' order' AS abstract,
      o_custkey::BIGINT AS cited_by_count, o_orderpriority AS concept, 'person ' || o_custkey AS author, CASE WHEN o_orderkey % 3 <> 0 THEN 'site ' || o_orderstatus END AS place,
      (o_orderkey % 2)::INT AS n_refs FROM orders""",
)
def _(spark, d):
    k = F.col("k")
    named = lambda i, n: F.struct(i.alias("id"), n.alias("display_name"))
    place = F.when(F.col("o_orderkey") % 3 != 0, F.array(named(F.lit("i/1"), F.concat(F.lit("site "), F.col("o_orderstatus")))))
    page = F.to_json(
        F.struct(
            F.concat(F.lit("w/W"), k).alias("id"), F.concat(F.lit("title "), k).alias("title"), F.col("day").alias("publication_date"),
            F.create_map(F.lit("order"), F.array(F.lit(0), F.lit(2)), F.col("o_orderpriority"), F.array(F.lit(1))).alias("abstract_inverted_index"),
            F.col("o_custkey").alias("cited_by_count"),
            F.array(F.struct(F.lit("c/1").alias("id"), F.col("o_orderpriority").alias("display_name"), F.lit(0.5).alias("score"))).alias("concepts"),
            F.array(F.struct(named(F.lit("a/1"), F.concat(F.lit("person "), F.col("o_custkey").cast("string"))).alias("author"), place.alias("institutions"))).alias("authorships"),
            F.when(F.col("o_orderkey") % 2 == 1, F.array(F.lit("w/W0"))).alias("referenced_works"),
        )
    )
    works = S.normalize_openalex(orders(spark, d).select(F.from_json(page, WORK).alias("w")).select("w.*"))
    return works.select(
        "id", "source", "title", "publication_date", "abstract", "cited_by_count", F.get("concepts.name", F.lit(0)).alias("concept"),
        F.get("authorships.author.name", F.lit(0)).alias("author"), F.get(F.get("authorships.institutions", F.lit(0))["name"], F.lit(0)).alias("place"), F.size("referenced_works").alias("n_refs"),
    )


PREPRINT = "id string, title string, summary string, arxiv_doi string, published string, tags array<struct<term:string>>, authors array<struct<name:string>>"


def preprints(spark, d):
    k = F.col("k")
    entry = F.to_json(
        F.struct(
            F.concat(F.lit("http://host/abs/"), k, F.lit("v"), (F.col("o_orderkey") % 3 + 1).cast("string")).alias("id"), F.concat(F.lit("  title "), k, F.lit(" ")).alias("title"),
            F.lit(" about ").alias("summary"), F.concat(F.col("day"), F.lit("T00:00:00Z")).alias("published"),
            F.array(F.struct(F.col("o_orderpriority").alias("term")), F.struct(F.lit("").alias("term"))).alias("tags"),
            F.array(F.struct(F.concat(F.lit("person "), F.col("o_custkey").cast("string")).alias("name"))).alias("authors"),
        )
    )
    return S.normalize_arxiv(orders(spark, d).select(F.from_json(entry, PREPRINT).alias("e")).select("e.*"))


@query(
    "src_06_preprints_from_feed",
    f"""SELECT 'arxiv:' || o_orderkey AS id, 'title ' || o_orderkey AS title, 'about' AS abstract, o_orderpriority AS categories, 'person ' || o_custkey AS authors, {DAY} AS publication_date FROM orders""",
)
def _(spark, d):
    return preprints(spark, d).select(
        "id", "title", "abstract", F.array_join("categories", "|").alias("categories"), F.array_join("authors.name", "|").alias("authors"), "publication_date"
    )


@query(
    "prj_02_preprint_triples",
    f"""SELECT 'arxiv:' || o_orderkey AS head, 'belongs_to' AS relation, 'cat:' || o_orderpriority AS tail, 'Concept' AS tail_type, {DAY} AS time FROM orders
    UNION ALL SELECT 'arxiv:' || o_orderkey, 'authored_by', 'author:' || sha1('arxiv|Author|person ' || o_custkey), 'Author', {DAY} FROM orders""",
)
def _(spark, d):
    return X.extract_preprint_triples(preprints(spark, d))[0].select("head", "relation", "tail", "tail_type", "time")


def patents(spark, d):
    p = B.table(spark, d, "part")
    one = lambda c: F.array(F.col(c))
    return p.select(
        F.concat(F.lit("uspto:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.lit("2001-02-03").alias("publication_date"),
        F.array("p_brand", "p_type").alias("cpc"), one("p_name").alias("assignees"), one("p_type").alias("inventors"), F.lit("B2").alias("kind"),
    )


NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[\\s_-]+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_ ]', '', 'g'), ' +', ' ', 'g'))"


@query(
    "prj_03_patent_triples",
    f"""WITH p AS (SELECT 'uspto:' || p_partkey AS head, * FROM part)
    SELECT head, 'belongs_to' AS relation, 'cpc:' || p_brand AS tail, 'Concept' AS tail_type FROM p UNION ALL SELECT head, 'belongs_to', 'cpc:' || p_type, 'Concept' FROM p
    UNION ALL SELECT head, 'affiliated_with', 'institution:' || sha1('uspto|Institution|' || {NORM.format('p_name')}), 'Institution' FROM p
    UNION ALL SELECT head, 'authored_by', 'person:' || sha1('uspto|Person|' || {NORM.format('p_type')}), 'Person' FROM p""",
)
def _(spark, d):
    return X.extract_patent_triples(patents(spark, d))[0].select("head", "relation", "tail", "tail_type")


def repositories(spark, d):
    e = B.table(spark, d, "events")
    item = F.to_json(
        F.struct(
            F.concat(F.lit("o/r"), F.col("user_id").cast("string")).alias("full_name"), F.lit("u").alias("html_url"), F.floor("value").cast("bigint").alias("stargazers_count"),
            F.array("event_type").alias("topics"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.col("event_id").alias("fetched_seq"),
        )
    )
    shape = "full_name string, description string, html_url string, stargazers_count bigint, topics array<string>, created_at string, fetched_seq bigint"
    return R.normalize_repos(e.select(F.from_json(item, shape).alias("i")).select("i.*"))


FIRST = """f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"""


@query(
    "src_16_repositories",
    f"WITH {FIRST} SELECT 'github:o/r' || user_id AS id, 'o/r' || user_id AS name, floor(value)::BIGINT AS stars, event_type AS topics, strftime(ts, '%Y-%m-%d') AS created_at FROM f WHERE rn = 1",
)
def _(spark, d):
    return repositories(spark, d).select("id", "name", "stars", F.array_join("topics", "|").alias("topics"), "created_at")


@query(
    "prj_04_repository_triples",
    f"WITH {FIRST} SELECT 'github:o/r' || user_id AS head, 'belongs_to' AS relation, 'topic:' || event_type AS tail, strftime(ts, '%Y-%m-%d') AS time FROM f WHERE rn = 1",
)
def _(spark, d):
    return X.extract_repo_triples(repositories(spark, d))[0].select("head", "relation", "tail", "time")


def feed(spark, d):
    item = F.to_json(
        F.struct(
            F.col("url").alias("link"), F.concat(F.lit(" page "), F.col("page_id").cast("string"), F.lit(" ")).alias("title"), F.lit("<p>short &amp; plain</p>").alias("summary"),
            F.when(F.col("page_id") % 2 == 0, "Tue, 05 Mar 2024 10:00:00 GMT").otherwise("2024-03-06T01:02:03Z").alias("published"),
        )
    )
    shape = "link string, title string, summary string, published string, updated string"
    return N.normalize_rss(B.table(spark, d, "pages").select(F.from_json(item, shape).alias("i")).select("i.*"))


@query(
    "src_17_feed_items",
    """SELECT 'rsshub:' || url AS id, 'page ' || page_id AS title, 'short & plain' AS text, url, CASE WHEN page_id % 2 = 0 THEN '2024-03-05' ELSE '2024-03-06' END AS publication_date FROM pages""",
)
def _(spark, d):
    return feed(spark, d).select("id", "title", "text", "url", "publication_date")


@query(
    "src_14_event_lines",
    f"""SELECT 'gdelt:' || o_orderkey AS id, o_orderpriority || '|' || o_orderstatus AS themes, 'person ' || o_custkey AS persons, (o_custkey % 7)::DOUBLE AS tone, {DAY} AS publication_date,
      'themes:' || o_orderpriority || ', ' || o_orderstatus || ' persons:person ' || o_custkey AS text FROM orders""",
)
def _(spark, d):
    return events(spark, d).select("id", F.array_join("themes", "|").alias("themes"), F.array_join("persons", "|").alias("persons"), "tone", "publication_date", "text")


def events(spark, d):
    """Orders as tab-separated event lines; every cell that the parser does not read stays empty."""
    last = max(N.COL_ID, N.COL_DATE, N.COL_THEMES, N.COL_PERSONS, N.COL_ORGS, N.COL_TONE)
    cells = {
        N.COL_ID: F.col("k"), N.COL_DATE: F.date_format("o_orderdate", "yyyyMMdd"), N.COL_PERSONS: F.concat(F.lit("person "), F.col("o_custkey").cast("string"), F.lit(",3;")),
        N.COL_THEMES: F.concat("o_orderpriority", F.lit(",1;"), F.col("o_orderstatus"), F.lit(",2;"), F.col("o_orderpriority"), F.lit(",9")),
        N.COL_TONE: F.concat((F.col("o_custkey") % 7).cast("string"), F.lit(",1,2")),
    }
    line = F.concat_ws("\t", *[cells.get(i, F.lit("")) for i in range(last + 1)])
    return N.normalize_gkg(orders(spark, d).select(line.alias("value")))


@query(
    "prj_05_news_triples",
    f"""SELECT 'gdelt:' || o_orderkey AS head, 'belongs_to' AS relation, 'theme:' || o_orderpriority AS tail, {DAY} AS time FROM orders
    UNION ALL SELECT 'gdelt:' || o_orderkey, 'belongs_to', 'theme:' || o_orderstatus, {DAY} FROM orders
    UNION ALL SELECT 'gdelt:' || o_orderkey, 'mentions', 'person:' || sha1('gdelt|Person|person ' || o_custkey), {DAY} FROM orders""",
)
def _(spark, d):
    return X.extract_news_triples(events(spark, d))[0].select("head", "relation", "tail", "time")


@query(
    "src_19_counts_from_payload",
    """SELECT event_id::VARCHAR AS topic_id, CASE WHEN event_id % 5 > 1 THEN CASE WHEN event_id % 5 = 2 THEN 0 ELSE floor(value)::BIGINT END END AS activity_count,
      CASE WHEN event_id % 5 > 1 THEN 'ok' ELSE 'failed' END AS collection_status,
      CASE event_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'non-JSON response: <html>busy</html>' END AS error FROM events""",
)
def _(spark, d):
    case = F.col("event_id") % 5
    total = F.floor("value").cast("bigint").cast("string")
    body = F.when(case == 1, "<html>busy</html>").when(case == 2, '{"message": {}}').otherwise(F.concat(F.lit('{"message": {"total-results": '), total, F.lit("}}")))
    raw = B.table(spark, d, "events").select(
        F.lit("crossref").alias("source"), F.col("event_id").cast("string").alias("topic_id"), F.col("event_type").alias("topic_label"), B.iso("ts").alias("window_start"),
        B.iso("ts").alias("window_end"), body.alias("payload"), F.when(case == 0, "timeout").alias("error"),
    )
    return A.counts_from_payload(raw, "crossref").select("topic_id", "activity_count", "collection_status", "error")


@query(
    "scl_13_redact_url",
    """SELECT page_id, split_part(url, '?', 1) || '?a=1&token=%5BREDACTED%5D&b=2&Api_Key=%5BREDACTED%5D' AS url FROM pages""",
)
def _(spark, d):
    raw = F.concat(F.substring_index("url", "?", 1), F.lit("?a=1&token="), F.col("page_id").cast("string"), F.lit("&b=2&Api_Key=z"))
    return B.table(spark, d, "pages").select("page_id", text.redact_url(raw).alias("url"))


@query(
    "scl_15_address_name",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_name ELSE 'First ' || c_custkey END AS name FROM customer""",
)
def _(spark, d):
    case = F.col("c_custkey") % 3
    org, plain = F.when(case == 0, F.concat(F.lit(" "), F.col("c_mktsegment"))).otherwise(" "), F.when(case != 2, F.col("c_name"))
    return B.table(spark, d, "customer").select("c_custkey", text.address_name(org, plain, F.lit("First"), F.col("c_custkey").cast("string")).alias("name"))


RUNS = """runs AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, user_id % 3 = 0 AS noop, CASE WHEN user_id % 5 = 0 THEN 'error' ELSE 'ok' END AS status, event_type, floor(value)::BIGINT AS n
  FROM events WHERE ts >= TIMESTAMP '2024-01-15')"""


def runs(spark, d):
    """Run manifests: one for each event."""
    e = B.table(spark, d, "events")
    return e.select(
        B.iso("ts").alias("started_at"), (F.col("user_id") % 3 == 0).alias("noop"), F.when(F.col("user_id") % 5 == 0, "error").otherwise("ok").alias("status"),
        F.create_map("event_type", F.floor("value").cast("bigint")).alias("new_records"),
    )


@query(
    "agg_20_run_rollup",
    f"WITH {RUNS} SELECT count(*) FILTER (NOT noop AND status = 'ok') AS n_ok, count(*) FILTER (noop) AS n_noop, count(*) FILTER (NOT noop AND status <> 'ok') AS n_error FROM runs",
)
def _(spark, d):
    return I.weekly_rollup(runs(spark, d), "2024-01-15")[0]


@query("agg_20_run_records", f"WITH {RUNS} SELECT event_type AS source, sum(n)::BIGINT AS new_records FROM runs GROUP BY 1")
def _(spark, d):
    return I.weekly_rollup(runs(spark, d), "2024-01-15")[1]
