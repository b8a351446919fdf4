"""Scholarly works, DOI records and preprints to the common work and preprint tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risewatch.functions.dates import date_from_parts
from risewatch.functions.text import blank_to_null, plain_abstract


def abstract_from_index(index: Column) -> Column:
    """Word -> positions map back to running text; null or empty map gives null."""
    spots = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word"))),
        )
    )
    text = F.array_join(F.transform(F.array_sort(spots), lambda s: s["word"]), " ")
    return F.when(F.size(F.map_keys(index)) > 0, text)


def normalize_openalex(raw: DataFrame) -> DataFrame:
    """Prune fields, rename display names, restore the abstract."""
    named = lambda c: F.struct(c["id"].alias("id"), c["display_name"].alias("name"))
    none = F.array()
    return raw.select(
        "id",
        F.lit("openalex").alias("source"),
        "title",
        "doi",
        "publication_date",
        abstract_from_index(F.col("abstract_inverted_index")).alias("abstract"),
        "cited_by_count",
        F.coalesce(
            F.transform(
                "concepts",
                lambda c: F.struct(c["id"].alias("id"), c["display_name"].alias("name"), c["score"].alias("score")),
            ),
            none.cast("array<struct<id:string,name:string,score:double>>"),
        ).alias("concepts"),
        F.coalesce(
            F.transform(
                "authorships",
                lambda a: F.struct(
                    named(a["author"]).alias("author"),
                    F.coalesce(
                        F.transform(a["institutions"], named), none.cast("array<struct<id:string,name:string>>")
                    ).alias("institutions"),
                ),
            ),
            none.cast("array<struct<author:struct<id:string,name:string>,institutions:array<struct<id:string,name:string>>>>"),
        ).alias("authorships"),
        F.coalesce("referenced_works", none.cast("array<string>")).alias("referenced_works"),
    )


def normalize_crossref(raw: DataFrame) -> DataFrame:
    """DOI-keyed items to works: lower-case id, first title, first date found, subjects as concepts of score 1."""
    doi = blank_to_null(F.trim("DOI"))
    title = F.when(F.size("title") > 0, F.get("title", F.lit(0))).otherwise(F.get("container-title", F.lit(0)))
    date = F.coalesce(*[date_from_parts(F.col(f"{c}.`date-parts`")) for c in ("published", "issued", "created")])
    none = F.array()
    person = lambda a: blank_to_null(F.trim(F.concat_ws(" ", blank_to_null(a["given"]), blank_to_null(a["family"]))))
    return raw.select(
        F.concat(F.lit("doi:"), F.lower(doi)).alias("id"),
        F.lit("crossref").alias("source"),
        blank_to_null(title).alias("title"),
        doi.alias("doi"),
        date.alias("publication_date"),
        plain_abstract(F.col("abstract")).alias("abstract"),
        F.lit(None).cast("bigint").alias("cited_by_count"),
        F.coalesce(
            F.transform(
                F.filter("subject", lambda s: s != ""),
                lambda s: F.struct(F.concat(F.lit("crossref:"), s).alias("id"), s.alias("name"), F.lit(1.0).alias("score")),
            ),
            none.cast("array<struct<id:string,name:string,score:double>>"),
        ).alias("concepts"),
        F.coalesce(
            F.transform(
                "author",
                lambda a: F.struct(
                    F.struct(F.lit(None).cast("string").alias("id"), person(a).alias("name")).alias("author"),
                    none.cast("array<struct<id:string,name:string>>").alias("institutions"),
                ),
            ),
            none.cast("array<struct<author:struct<id:string,name:string>,institutions:array<struct<id:string,name:string>>>>"),
        ).alias("authorships"),
        F.coalesce(
            F.filter(F.col("reference.DOI"), lambda d: d != ""), none.cast("array<string>")
        ).alias("referenced_works"),
    )


def preprint_id(url: Column) -> Column:
    """``.../abs/<id>vN`` to ``arxiv:<id>``, else the last path segment; blank stays blank."""
    url = F.coalesce(url, F.lit(""))
    tail = F.element_at(F.split(url, "/abs/"), -1)
    return (
        F.when(url.contains("/abs/"), F.concat(F.lit("arxiv:"), F.regexp_replace(tail, r"v\d+$", "")))
        .when(url != "", F.concat(F.lit("arxiv:"), F.element_at(F.split(url, "/"), -1)))
        .otherwise("")
    )


def normalize_arxiv(raw: DataFrame) -> DataFrame:
    """Feed entries to preprints: id without version, ten-character date, non-blank categories and authors."""
    return raw.select(
        preprint_id(F.col("id")).alias("id"),
        F.lit("arxiv").alias("source"),
        F.trim(F.coalesce("title", F.lit(""))).alias("title"),
        F.col("arxiv_doi").alias("doi"),
        F.trim(F.coalesce("summary", F.lit(""))).alias("abstract"),
        F.filter(F.col("tags.term"), lambda t: t != "").alias("categories"),
        F.transform(
            F.filter(F.col("authors.name"), lambda n: n != ""), lambda n: F.struct(n.alias("name"))
        ).alias("authors"),
        F.substring(F.coalesce("published", F.lit("")), 1, 10).alias("publication_date"),
    )


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Atom files, one row per ``<entry>``, in the raw preprint layout."""
    schema = (
        "id string, title string, summary string, doi string, published string, "
        "category array<struct<_term:string>>, author array<struct<name:string>>"
    )
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return rows.select(
        "id",
        "title",
        "summary",
        F.col("doi").alias("arxiv_doi"),
        "published",
        F.transform("category", lambda c: F.struct(c["_term"].alias("term"))).alias("tags"),
        F.col("author").alias("authors"),
    )
