"""Named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


# Common table expressions of the SQL counterparts (DuckDB dialect).
MENTIONS = """mentions AS (
  SELECT o.o_orderkey AS doc_id, p.p_name AS entity, strftime(o.o_orderdate, '%Y-%m-%d') AS time,
         l.l_extendedprice AS score, l.l_linenumber AS pos
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey)"""
COUNTS = MENTIONS + """, counts AS (
  SELECT entity, substr(time, 1, 7) AS bin, count(*) AS cnt FROM mentions GROUP BY 1, 2)"""
DENSE = COUNTS + """, bins AS (
  SELECT bin, row_number() OVER (ORDER BY bin) AS ord, count(*) OVER () AS n FROM (SELECT DISTINCT bin FROM counts)),
dense AS (
  SELECT e.entity, b.bin, b.ord, b.n, coalesce(c.cnt, 0)::DOUBLE AS x
  FROM (SELECT DISTINCT entity FROM counts) e CROSS JOIN bins b LEFT JOIN counts c ON c.entity = e.entity AND c.bin = b.bin)"""
CITATIONS = """cites AS (
  SELECT l.l_partkey::VARCHAR AS head, l.l_orderkey::VARCHAR AS tail, strftime(o.o_orderdate, '%Y-%m-%d') AS time
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_partkey <> l.l_orderkey)"""
DIRECTED = """directed AS (
  SELECT ns.n_name AS head,
         CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'uses' WHEN '2' THEN 'improves' WHEN '3' THEN 'compares'
              WHEN '4' THEN 'targets' ELSE 'competes' END AS relation,
         nc.n_name AS tail, strftime(o.o_orderdate, '%Y-%m-%d') AS time
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation ns ON ns.n_nationkey = s.s_nationkey
  JOIN nation nc ON nc.n_nationkey = c.c_nationkey)"""
