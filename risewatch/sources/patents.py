"""Patent bulk files: concatenated XML, bibliographies, citations, citation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risewatch.functions.dates import clean_date, compact_to_iso, file_date
from risewatch.functions.text import address_name, blank_to_null, decode_entities

_PERSON = "addressbook struct<orgname:string,name:string,`last-name`:string,`first-name`:string>"
_DOCUMENT = "`document-id` struct<country:string,`doc-number`:string,kind:string,date:string>"


def read_concat_xml(spark: SparkSession, glob: str) -> DataFrame:
    """One row per XML document of files that hold many; declaration and DOCTYPE removed, broken ones dropped."""
    lines = spark.read.option("lineSep", "<?xml").text(glob).select(
        "value", file_date(F.col("_metadata.file_name")).alias("file_date")
    )
    body = F.trim(F.regexp_replace("value", r"^[^>]*\?>\s*(<!DOCTYPE[^>]*>)?", ""))
    docs = lines.select(body.alias("xml"), "file_date").where("xml <> ''")
    return docs.where(is_well_formed(F.col("xml")))


def is_well_formed(xml: Column) -> Column:
    parsed = F.from_xml(xml, "_bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return parsed["_bad"].isNull()


def _part(xml: Column, tag: str) -> Column:
    return F.regexp_extract(xml, rf"(?s)<{tag}[\s>].*?</{tag}>", 0)


def _typed(fragment: Column, schema: str) -> Column:
    """Fragment parsed with a schema; a missing fragment gives null fields."""
    return F.from_xml(F.when(fragment == "", F.lit("<none/>")).otherwise(fragment), schema, {"mode": "PERMISSIVE"})


def _names(xml: Column, group: str, item: str) -> Column:
    rows = _typed(_part(xml, group), f"{item} array<struct<{_PERSON.replace(' struct', ':struct')}>>")[item]
    names = F.transform(
        rows,
        lambda r: address_name(
            r["addressbook"]["orgname"],
            r["addressbook"]["name"],
            r["addressbook"]["first-name"],
            r["addressbook"]["last-name"],
        ),
    )
    return F.coalesce(F.array_distinct(F.array_compact(names)), F.array().cast("array<string>"))


def _document_id(xml: Column) -> Column:
    return _typed(_part(xml, "publication-reference"), _DOCUMENT)["document-id"]


def parse_patent_biblio(docs: DataFrame) -> DataFrame:
    """Id, title, abstract, people, classes, date and kind of each document; documents without a number dropped."""
    x = F.col("xml")
    inner = lambda tag: F.regexp_extract(x, rf"(?s)<{tag}(?:\s[^>]*)?>([^<]*)", 1)
    paragraphs = F.filter(
        F.transform(F.regexp_extract_all(_part(x, "abstract"), F.lit(r"<p(?:\s[^>]*)?>([^<]*)"), 1), lambda p: F.trim(p)),
        lambda p: p != "",
    )
    blocks = F.regexp_extract_all(_part(x, "classifications-cpc"), F.lit(r"(?s)<classification-cpc>.*?</classification-cpc>"), 0)
    code = lambda b, t: F.regexp_extract(b, rf"<{t}>([^<]*)</{t}>", 1)
    cpc = F.array_distinct(
        F.filter(
            F.transform(blocks, lambda b: F.trim(F.concat(code(b, "section"), code(b, "class"), code(b, "subclass")))),
            lambda c: c != "",
        )
    )
    d = F.col("_d")
    return (
        docs.withColumn("_d", _document_id(x))
        .where(d["doc-number"].isNotNull() & (d["doc-number"] != ""))
        .select(
            F.concat(F.lit("uspto:"), d["doc-number"]).alias("id"),
            F.lit("uspto").alias("source"),
            decode_entities(inner("invention-title")).alias("title"),
            decode_entities(F.array_join(paragraphs, " ")).alias("abstract"),
            _names(x, "assignees", "assignee").alias("assignees"),
            _names(x, "inventors", "inventor").alias("inventors"),
            compact_to_iso(F.coalesce(d["date"], F.lit(""))).alias("publication_date"),
            cpc.alias("cpc"),
            F.coalesce(d["kind"], F.lit("")).alias("kind"),
        )
    )


def filter_patents(
    df: DataFrame, prefixes: Sequence[str], from_date: str | None = None
) -> DataFrame:
    """Any class starting with a prefix, published on or after the date (undated pass)."""
    wanted = F.array(*[F.lit(p) for p in prefixes])
    out = df.where(F.exists("cpc", lambda c: F.exists(wanted, lambda p: F.startswith(c, p))))
    if from_date:
        date = F.coalesce("publication_date", F.lit(""))
        out = out.where((date == "") | (date >= from_date))
    return out


def patent_backward_citations(docs: DataFrame) -> DataFrame:
    """US patents cited by each document: ``citing, citing_date, cited, cited_date``."""
    x, d = F.col("xml"), F.col("_d")
    cites = _typed(
        _part(x, "us-references-cited"),
        f"`us-citation` array<struct<patcit:struct<{_DOCUMENT.replace(' struct', ':struct')}>>>",
    )["us-citation"]
    rows = (
        docs.withColumn("_d", _document_id(x))
        .where(d["doc-number"].isNotNull() & (d["doc-number"] != ""))
        .select("_d", F.explode(cites).alias("c"))
        .select("_d", F.col("c.patcit.document-id").alias("t"))
    )
    t = F.col("t")
    country = F.trim(F.coalesce(t["country"], F.lit("")))
    return rows.where(t["doc-number"].isNotNull() & (F.trim(t["doc-number"]) != "") & country.isin("", "US")).select(
        F.concat(F.lit("uspto:"), d["doc-number"]).alias("citing"),
        compact_to_iso(F.coalesce(d["date"], F.lit(""))).alias("citing_date"),
        F.concat(F.lit("uspto:"), F.trim(t["doc-number"])).alias("cited"),
        F.trim(F.coalesce(t["date"], F.lit(""))).alias("cited_date"),
    )


def _alias(df: DataFrame, *names: str) -> str | None:
    by_lower = {c.lower(): c for c in df.columns}
    return next((by_lower[n] for n in names if n in by_lower), None)


def patent_lookup(df: DataFrame) -> DataFrame:
    """``patent_id, number, date`` with the number falling back to the id; one row per id."""
    pid, num, date = _alias(df, "patent_id"), _alias(df, "patent_number"), _alias(df, "patent_date")
    if pid is None:
        raise ValueError("patent table needs a patent_id column")
    key = F.trim(F.col(pid))
    number = blank_to_null(F.trim(F.col(num))) if num else F.lit(None).cast("string")
    rows = df.where(key != "").select(
        key.alias("patent_id"),
        F.coalesce(number, key).alias("number"),
        (clean_date(F.col(date)) if date else F.lit("")).alias("date"),
    )
    return rows.groupBy("patent_id").agg(F.max(F.struct("date", "number")).alias("_b")).select(
        "patent_id", "_b.number", "_b.date"
    )


def citations_from_tsv(cites: DataFrame, patents: DataFrame) -> DataFrame:
    """Citation table joined with patent dates on both ends; old and new header names are accepted.

    The patent table is aggregated to one row per id; Spark broadcasts it only if its measured size allows.
    """
    pid = _alias(cites, "patent_id")
    cid = _alias(cites, "citation_id", "citation_patent_id")
    day = _alias(cites, "date", "citation_date")
    if pid is None or cid is None:
        raise ValueError("citation table needs patent_id and citation_id (or citation_patent_id)")
    look = patent_lookup(patents)
    a = look.select(F.col("patent_id").alias("_a"), F.col("number").alias("_an"), F.col("date").alias("_ad"))
    b = look.select(F.col("patent_id").alias("_b"), F.col("number").alias("_bn"), F.col("date").alias("_bd"))
    rows = cites.select(
        F.trim(F.col(pid)).alias("_pid"), F.trim(F.col(cid)).alias("_cid"), (F.col(day) if day else F.lit("")).alias("_day")
    ).where("_pid <> '' and _cid <> ''")
    joined = rows.join(a, F.col("_pid") == F.col("_a"), "left").join(b, F.col("_cid") == F.col("_b"), "left")
    return joined.select(
        F.concat(F.lit("uspto:"), F.coalesce("_an", "_pid")).alias("citing"),
        F.coalesce(blank_to_null(F.col("_ad")), clean_date(F.col("_day"))).alias("citing_date"),
        F.concat(F.lit("uspto:"), F.coalesce("_bn", "_cid")).alias("cited"),
        F.coalesce("_bd", F.lit("")).alias("cited_date"),
    )


def citations_from_csv(
    df: DataFrame,
    patent_col: str = "patent",
    cited_by_col: str = "cited_by",
    cited_date_col: str = "cited_by_date",
    patent_date_col: str = "publication_date",
) -> DataFrame:
    """Forward rows of a CSV export reordered to citing / cited pairs."""
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return df.where((t(patent_col) != "") & (t(cited_by_col) != "")).select(
        F.concat(F.lit("uspto:"), t(cited_by_col)).alias("citing"),
        t(cited_date_col).alias("citing_date"),
        F.concat(F.lit("uspto:"), t(patent_col)).alias("cited"),
        t(patent_date_col).alias("cited_date"),
    )


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).csv(path)
