"""Date strings: the engine keeps ISO text (``yyyy-MM-dd`` or a prefix of it) and compares it as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_to_iso(c: Column) -> Column:
    """``yyyyMMdd`` to ISO when the text has exactly eight characters, else unchanged."""
    iso = F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))
    return F.when(F.length(c) == 8, iso).otherwise(c)


def clean_date(c: Column) -> Column:
    """ISO prefix, ``M/D/Y`` with a two-digit pivot at 50, else the first ten characters."""
    s = F.trim(F.coalesce(c, F.lit("")))
    parts = F.split(s, "/")
    month, day, year = (F.get(parts, F.lit(i)).try_cast("int") for i in range(3))
    full = F.when(year >= 100, year).when(year > 50, year + 1900).otherwise(year + 2000)
    slashed = F.when(
        month.isNotNull() & day.isNotNull() & year.isNotNull(), F.format_string("%04d-%02d-%02d", full, month, day)
    ).otherwise("")
    return (
        F.when(s == "", "")
        .when(s.rlike(r"^\d{4}-.{5}"), F.substring(s, 1, 10))
        .when(F.size(parts) == 3, slashed)
        .otherwise(F.substring(s, 1, 10))
    )


def date_from_parts(parts: Column) -> Column:
    """``[[Y, M, D]]`` to ISO text, shortened when month or day is missing."""
    first = F.get(parts, F.lit(0))
    y, m, d = (F.get(first, F.lit(i)) for i in range(3))
    return (
        F.when(y.isNull(), F.lit(None).cast("string"))
        .when(m.isNull(), F.format_string("%04d", y))
        .when(d.isNull(), F.format_string("%04d-%02d", y, m))
        .otherwise(F.format_string("%04d-%02d-%02d", y, m, d))
    )


def file_date(path: Column) -> Column:
    """Eight-digit date in a file name, empty when there is none."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{8})", 1)


def time_bin(c: Column, mode: str = "month") -> Column:
    return F.substring(c, 1, 10 if mode == "day" else 7)


def month_add(c: Column, n: Column | int) -> Column:
    """Shift ``yyyy-MM`` by ``n`` months."""
    return F.date_format(F.add_months(F.to_date(F.concat(c, F.lit("-01"))), n), "yyyy-MM")
