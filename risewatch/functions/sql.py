"""SQL-callable forms of the functions Spark does not have; bursts are SQL-defined, from the operator's own expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

from risewatch.functions.text import decode_entities
from risewatch.operators.bursts import burst_sql
from risewatch.operators.resolve import indel_similarity

_ROWS = "TABLE(start INT, `end` INT, weight DOUBLE)"
# where a run of 1 in the states begins and ends, positions from 1
_RUNS = """transform(array(split(path, '')), b -> zip_with(
    filter(sequence(1, size(b)), i -> get(b, i - 1) = '1' AND NOT get(b, i - 2) <=> '1'),
    filter(sequence(1, size(b)), i -> get(b, i - 1) = '1' AND NOT get(b, i) <=> '1'), (s, e) -> named_struct('s', s, 'e', e)))[0]"""


def register(spark: SparkSession) -> None:
    """Register temporary functions of this session.

    ``indel_similarity(a, b)``; ``decode_entities(text)``; ``burst_array(counts, s, gamma)``: array of burst segments;
    ``burst_rows(counts, s, gamma)``: the same as a table; ``burst_segments(path, counts)``: table of the runs of 1 in a
    string of states, with the largest count of each.
    """
    spark.udf.register("indel_similarity", indel_similarity)
    spark.udf.register("decode_entities", decode_entities)
    series = "counts ARRAY<DOUBLE>, s DOUBLE, gamma DOUBLE"
    found = burst_sql("counts", "size(counts)", "s", "gamma")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION burst_array({series}) RETURNS ARRAY<STRUCT<start: INT, `end`: INT, weight: DOUBLE>> RETURN {found}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION burst_rows({series}) RETURNS {_ROWS} RETURN SELECT b.start, b.`end`, b.weight FROM (SELECT explode({found}) AS b)")
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION burst_segments(path STRING, counts ARRAY<DOUBLE>) RETURNS {_ROWS}
        RETURN SELECT r.s - 1, r.e - 1, array_max(slice(counts, r.s, r.e - r.s + 1)) FROM (SELECT explode({_RUNS}) AS r)"""
    )
