"""String column expressions: ids, names, markup, keys."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def tail_id(c: Column) -> Column:
    """Last path segment of a URL-like id; null and empty stay null."""
    return F.when(c != "", F.substring_index(F.rtrim(c, F.lit("/")), "/", -1))


def normalize_name(c: Column) -> Column:
    """Lower case, separators to one space, punctuation dropped (any script)."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[\s\x1c-\x1f_\-]+", " ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_ ]", "")
    return F.trim(F.regexp_replace(s, " +", " "))


@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    """Named and numeric character references; rows without ``&`` pass through."""
    return s.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(T.StringType())
def decode_closed(s: pd.Series) -> pd.Series:
    """References that end in a semicolon; a name without one (``&amp``, ``&copy=1``) stays as written."""
    one = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]
    return s.map(lambda t: _CLOSED.sub(one, t) if t is not None and "&" in t else t)


def _squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def plain_abstract(c: Column, closed: bool = False) -> Column:
    """Decode first, then drop tags; blank becomes null. ``closed`` decodes only references that end in a semicolon."""
    decode = decode_closed if closed else decode_entities
    return blank_to_null(_strip(_squeeze(F.regexp_replace(decode(c), "<[^>]+>", " "))))


def plain_summary(c: Column, closed: bool = False) -> Column:
    """Drop tags first, then decode (feed items); blank stays an empty string. ``closed`` as for abstracts."""
    decode = decode_closed if closed else decode_entities
    return _strip(decode(_squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))))


def fallback_id(source: Column, node_type: Column, name: Column) -> Column:
    """Deterministic id of a name-only node: ``type:`` plus the SHA-1 of source, type and name."""
    key = F.concat_ws("|", source, node_type, normalize_name(name))
    return F.concat(F.lower(node_type), F.lit(":"), F.sha1(key))


# The labels in front of the title and the body.
TITLE_LABEL = "标题："
BODY_LABEL = "正文："


def document_text(title: Column, abstract: Column, text: Column, description: Column) -> Column:
    """Title line and body line, the body being the first non-blank of three fields."""
    body = F.coalesce(blank_to_null(abstract), blank_to_null(text), blank_to_null(description), F.lit(""))
    return _strip(F.concat(F.lit(TITLE_LABEL), F.coalesce(title, F.lit("")), F.lit("\n" + BODY_LABEL), body))


def cache_key(c: Column) -> Column:
    return F.sha2(c, 256)


def redact_url(c: Column) -> Column:
    """Hide the value of credential parameters in the query part of a URL."""
    return F.regexp_replace(c, r"(?i)([?&](?:api_key|apikey|key|token)=)[^&#]*", "$1%5BREDACTED%5D")


def split_counts(c: Column) -> Column:
    """``name,count;name,count`` to the distinct names in order of appearance."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda e: F.trim(F.split(e, ",")[0]))
    return F.array_distinct(F.filter(parts, lambda e: e != ""))


def address_name(orgname: Column, name: Column, first: Column, last: Column) -> Column:
    """Organisation, else plain name, else "first last"."""
    person = blank_to_null(F.trim(F.concat_ws(" ", blank_to_null(first), blank_to_null(last))))
    return F.coalesce(blank_to_null(F.trim(orgname)), blank_to_null(F.trim(name)), person)
