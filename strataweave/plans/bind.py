"""The star-schema tables seen as a code graph, a git history and telemetry.

Each view is one SELECT, kept as text: the engine runs it as a DataFrame, the oracle inlines the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataweave.sources.tables import table

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "g_repos": (("nation", "region"), """SELECT n_name AS name, r_name AS source_group, n_regionkey = 0 AS is_foundational,
      CASE n_nationkey % 4 WHEN 0 THEN 'C#' WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'Python' ELSE 'SQL' END AS language, n_nationkey AS age_days
      FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "g_nodes": (("customer", "supplier", "part", "orders"), """SELECT 10000000 + c_custkey AS id, 'NATION_' || c_nationkey AS project, c_mktsegment AS dotnet_project, 'Class' AS label, c_name AS name,
        'Crm.' || c_name AS qualified_name, 'src/crm/' || c_mktsegment || '.cs' AS file_path, CAST(c_custkey % 400 + 1 AS INT) AS start_line, CAST(c_custkey % 400 + 1 + c_custkey % 30 AS INT) AS end_line FROM customer
      UNION ALL SELECT 20000000 + s_suppkey, 'NATION_' || s_nationkey, CAST(NULL AS VARCHAR(20)), 'Service', s_name, 'Svc.' || s_name, 'src/svc/' || s_suppkey % 9 || '.cs', CAST(s_suppkey % 50 + 1 AS INT), CAST(s_suppkey % 50 + 20 AS INT) FROM supplier
      UNION ALL SELECT 30000000 + p_partkey, 'NATION_' || p_partkey % 25, p_brand, CASE p_size % 4 WHEN 0 THEN 'Method' WHEN 1 THEN 'Function' WHEN 2 THEN 'Route' ELSE 'Event' END, p_name, 'Cat.' || p_brand || '.' || p_partkey,
        CASE WHEN p_partkey % 7 = 0 THEN 'tests/' ELSE 'src/' END || p_brand || '/' || p_partkey % 20 || '.cs', CAST(p_partkey % 300 + 1 AS INT), CAST(p_partkey % 300 + 1 + p_size AS INT) FROM part
      UNION ALL SELECT 40000000 + o_orderkey, 'NATION_' || c_nationkey, c_mktsegment, 'Method', 'order_' || o_orderkey, 'Ord.' || o_custkey || '.' || o_orderkey, 'src/orders/' || o_custkey % 40 || '.cs', CAST(o_orderkey % 500 + 1 AS INT), CAST(o_orderkey % 500 + 9 AS INT)
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "g_edges": (("customer", "supplier", "orders", "lineitem"), """SELECT 10000000 + o_custkey AS source_id, 40000000 + o_orderkey AS target_id, 'DEFINES_METHOD' AS type, CAST(NULL AS DOUBLE) AS confidence FROM orders
      UNION ALL SELECT 40000000 + l_orderkey, 30000000 + l_partkey, 'CALLS', max(round(1 - 5 * l_discount, 4)) FROM lineitem GROUP BY l_orderkey, l_partkey
      UNION ALL SELECT DISTINCT 30000000 + l_partkey, 20000000 + l_suppkey, 'USES_TYPE', CAST(NULL AS DOUBLE) FROM lineitem WHERE l_linenumber = 1
      UNION ALL SELECT 20000000 + s_suppkey, 10000000 + c_custkey, 'HTTP_CALLS', CAST(NULL AS DOUBLE) FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey % 10 = c_custkey % 10"""),
    "g_cross": (("customer", "supplier", "orders", "lineitem"), """SELECT DISTINCT 'NATION_' || c_nationkey AS source_project, 'NATION_' || s_nationkey AS target_project, 40000000 + l_orderkey AS source_node_id, 20000000 + l_suppkey AS target_node_id,
        CASE l_returnflag WHEN 'R' THEN 'PUBLISHES' WHEN 'A' THEN 'HTTP_CALLS' ELSE 'REFERENCES_PACKAGE' END AS type
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey"""),
    "h_commits": (("orders",), """SELECT o_orderkey AS commit_id, 'author_' || o_custkey % 50 AS author, CAST(o_orderdate AS TIMESTAMP) AS author_date,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'hotfix rollback' WHEN '2-HIGH' THEN 'fix bug' ELSE 'feature' END AS message FROM orders"""),
    "h_touches": (("lineitem", "part"), """SELECT l_orderkey AS commit_id, CASE WHEN p_partkey % 7 = 0 THEN 'tests/' ELSE 'src/' END || p_brand || '/' || p_partkey || '.cs' AS path,
        CAST(l_quantity AS BIGINT) AS added, CAST(floor(l_quantity * l_discount * 10) AS BIGINT) AS removed, l_linenumber AS seq FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "t_tools": (("events",), "SELECT event_id, 'user' || user_id AS username, event_type AS tool_name, event_type <> 'error' AS success, CAST(floor(value) AS BIGINT) AS duration_ms, CAST(ts AS TIMESTAMP) AS created_at FROM events"),
    "m_claims": (("orders",), """SELECT o_orderkey AS claim_id, 'customer_' || o_custkey AS subject, lower(o_orderpriority) AS predicate, o_orderstatus AS value_text, CAST(o_orderdate AS TIMESTAMP) AS recorded_at,
        CASE WHEN o_orderkey % 17 = 0 THEN 'conflicted' ELSE 'active' END AS status FROM orders"""),
}


def view(spark: SparkSession, folder: str, name: str, **given: DataFrame) -> DataFrame:
    """A bound view; its tables are passed to the SELECT as DataFrames, those `given` instead of the folder's."""
    inputs, text = VIEWS[name]
    frames = {t: table(spark, folder, t) for t in inputs} | given
    for t in inputs:
        text = _replace_table(text, t)
    return spark.sql(text, **frames)


def _replace_table(text: str, name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)


def cte(*names: str) -> str:
    """The views as a WITH list for the oracle (without the word WITH)."""
    return ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
