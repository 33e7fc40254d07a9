"""Queries by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The record model over the star schema, as common table expressions.
BASE = """
WITH lab AS (
  SELECT l_orderkey AS id, p_type || '/' || p_brand AS slug, 1 - l_discount AS weight, l_returnflag <> 'N' AS corroborated
  FROM lineitem JOIN part ON l_partkey = p_partkey),
head AS (
  SELECT id, slug AS topic, corroborated AS topic_c FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, slug, corroborated DESC) AS rn FROM lab) WHERE rn = 1),
rec AS (
  SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%Y-%m') AS month,
         strftime(o_orderdate, '%Y') AS year, c_name AS agency, c_mktsegment AS agency_type, n_name AS province,
         o_orderpriority AS action, o_orderstatus AS govlevel, topic, coalesce(topic_c, false) AS topic_c,
         o_orderkey % 5 <> 0 AS action_c, o_orderkey % 7 <> 0 AS govlevel_c, (year(o_orderdate) - 1994)::INT AS volume,
         o_orderpriority AS part, (o_orderkey % 500)::INT AS page, 'Order ' || o_orderkey || ' ' || c_name AS title
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN head ON head.id = o_orderkey),
topics AS (
  SELECT DISTINCT p_type || '/' || p_brand AS slug, p_brand AS name, p_type AS parent FROM part
  UNION SELECT DISTINCT p_type, p_type, NULL FROM part),
clo AS (
  SELECT slug AS descendant, slug AS ancestor, 0 AS depth FROM topics
  UNION ALL SELECT slug, parent, 1 FROM topics WHERE parent IS NOT NULL),
rolled AS (
  SELECT year, ancestor AS topic, agency, count(*)::BIGINT AS n FROM rec JOIN clo ON topic = descendant
  WHERE topic_c AND agency IS NOT NULL GROUP BY ALL),
ta AS (SELECT topic, agency, sum(n)::BIGINT AS n FROM rolled GROUP BY ALL)
"""


def query(sql: str | None = None, base: bool = True, also: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; also: an earlier name that it keeps."""

    def put(f: Query) -> Query:
        for name in [f.__name__, *([also] if also else [])]:
            QUERIES[name] = f
            if sql is not None:
                SQL[name] = (BASE + sql) if base else sql
        return f

    return put
