"""The queries of the general problems, and their SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.operators import hierarchy as H
from strataweave.operators import references as R
from strataweave.plans.cut import Scope
from strataweave.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return H.roots(table(spark, d, "nodes"))


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    h = H.hierarchy(table(spark, d, "nodes"))
    return h.select("id", "root_id", "depth", F.array_join("path", "/").alias("path"), "n_descendants")


def p4_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Of every node the size of its interval of the numbering, and how far the interval of its parent fails to hold it (0: it holds it)."""
    h = H.hierarchy(table(spark, d, "nodes"), with_paths=False)
    up = h.select(F.col("id").alias("parent"), F.col("first").alias("a"), F.col("last").alias("b"))
    stray = F.greatest(F.col("a") + 1 - F.col("first"), F.col("last") - F.col("b"), F.lit(0))
    return h.join(up, "parent", "left").select("id", "root_id", (F.col("last") - F.col("first") + 1).alias("size"), F.when(F.col("first").isNotNull(), F.coalesce(stray, F.lit(0))).cast("int").alias("strays"))


def p4_projects(spark: SparkSession, d: str) -> DataFrame:
    """Trees, nodes, greatest depth and nodes lost to rings, by project."""
    nodes = table(spark, d, "nodes")
    of = nodes.where("id is not null").groupBy("id").agg(F.min(R.project_key(F.col("project"))).alias("project"))
    h = H.roots(nodes)
    return h.join(of, "id").groupBy("project").agg(F.count("*").alias("nodes"), F.count_if(F.col("depth") == 0).alias("roots"), F.max("depth").alias("max_depth"), F.count_if(F.col("depth") < 0).alias("in_rings"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_references(*(table(spark, d, t) for t in ("pending_edges", "cross_repo_impacts", "nodes", "repositories")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_id", "ref_field", "reason")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report(_orphans(spark, d))


def p6_current(spark: SparkSession, d: str) -> DataFrame:
    """Keys without any record at the end, and the references to them, by table: from a state advanced in two periods."""
    edges, impacts, nodes, repos = (table(spark, d, t) for t in ("pending_edges", "cross_repo_impacts", "nodes", "repositories"))
    at = int(datetime(2025, 1, 1, tzinfo=timezone.utc).timestamp() * 1_000_000)
    out = None
    with Scope() as s:
        for name, refs, lives in (("pending_edges", R.edge_references(edges), R.node_lives(nodes)), ("cross_repo_impacts", R.impact_references(impacts), R.repository_lives(repos))):
            refs = R.once(refs)
            state = s.cut(R.advance(None, R.key_deltas(refs, lives, until=at)), "state")
            state = s.keep(R.advance(state, R.key_deltas(refs, lives, after=at)), "state")
            one = R.current_orphans(state).agg(F.count("*").alias("orphan_keys"), F.coalesce(F.sum("references"), F.lit(0)).alias("orphan_references")).select(F.lit(name).alias("ref_table"), "orphan_keys", "orphan_references")
            out = one if out is None else out.unionByName(one)
        return out


# The white space characters that SQL trims, as one string.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288) || " + " || ".join(f"chr({c})" for c in range(8192, 8203))

_TREE = """WITH RECURSIVE n AS (
  SELECT id, arg_max(p, (t, p)) AS p FROM (SELECT id, coalesce(parent_node_id, -9) AS p, indexed_at AS t FROM nodes WHERE id IS NOT NULL) GROUP BY id),
k AS (SELECT n.id, CASE WHEN m.id IS NULL THEN NULL ELSE n.p END AS p FROM n LEFT JOIN n m ON n.p = m.id),
t AS (SELECT id, id AS root_id, 0 AS depth, CAST(id AS VARCHAR) AS path FROM k WHERE p IS NULL
  UNION ALL SELECT k.id, t.root_id, t.depth + 1, t.path || '/' || CAST(k.id AS VARCHAR) FROM k JOIN t ON k.p = t.id)
"""

_ORPHANS = f"""WITH e AS (
  SELECT pending_edge_id AS ref_id, lower(trim(project, {_WS})) AS project, source_qn, target_qn, extracted_at AS w FROM pending_edges
  QUALIFY row_number() OVER (PARTITION BY pending_edge_id ORDER BY received_at DESC) = 1),
r AS (SELECT 'pending_edges' AS ref_table, ref_id, 'source_qn' AS ref_field, project, source_qn AS k, w FROM e
  UNION ALL SELECT 'pending_edges', ref_id, 'target_qn', project, target_qn, w FROM e
  UNION ALL SELECT DISTINCT 'cross_repo_impacts', impact_id, 'target_project', '', lower(trim(target_project, {_WS})), computed_at FROM cross_repo_impacts),
x AS (SELECT DISTINCT lower(trim(project, {_WS})) AS project, qualified_name AS k, id, created_at, deleted_at FROM nodes
  UNION ALL SELECT DISTINCT '', lower(trim(name, {_WS})), 0, created_at, deleted_at FROM repositories),
f AS (SELECT ref_table, ref_id, ref_field, w, count(x.k) AS known,
    count(*) FILTER (WHERE x.created_at <= r.w AND (x.deleted_at IS NULL OR r.w < x.deleted_at)) AS living, count(*) FILTER (WHERE x.deleted_at <= r.w) AS ended
  FROM r LEFT JOIN x ON r.project = x.project AND r.k = x.k WHERE r.k IS NOT NULL AND trim(r.k, {_WS}) <> '' GROUP BY ALL),
o AS (SELECT ref_table, ref_id, ref_field, w, CASE WHEN known = 0 THEN 'missing' WHEN ended > 0 THEN 'deleted' ELSE 'late' END AS reason FROM f WHERE living = 0)
"""


def queries() -> dict:
    return {f.__name__: f for f in (p4_found, p4_hierarchy, p4_intervals, p4_projects, p6_found, p6_report, p6_current)}


def oracle_sql() -> dict[str, str]:
    sizes = "s AS (SELECT CAST(u.a AS BIGINT) AS id, count(*) - 1 AS n FROM (SELECT unnest(string_split(path, '/')) AS a FROM t) u GROUP BY 1)"
    return {
        "p4_found": _TREE + "SELECT k.id, coalesce(t.root_id, -1) AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth FROM k LEFT JOIN t ON k.id = t.id",
        "p4_hierarchy": _TREE + f", {sizes} SELECT k.id, coalesce(t.root_id, -1) AS root_id, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth, t.path, s.n AS n_descendants FROM k LEFT JOIN t ON k.id = t.id LEFT JOIN s ON k.id = s.id",
        "p4_projects": _TREE + f""", g AS (SELECT id, min(lower(trim(project, {_WS}))) AS project FROM nodes GROUP BY 1)
SELECT g.project, count(*) AS nodes, count(*) FILTER (WHERE t.depth = 0) AS roots, CAST(max(coalesce(t.depth, -1)) AS INTEGER) AS max_depth, count(*) FILTER (WHERE t.id IS NULL) AS in_rings
FROM k JOIN g ON k.id = g.id LEFT JOIN t ON k.id = t.id GROUP BY 1""",
        "p6_found": _ORPHANS + "SELECT ref_table, ref_id, ref_field, reason FROM o",
        "p6_current": _ORPHANS + f""", rk AS (SELECT ref_table, project, k, count(*) AS n FROM r WHERE k IS NOT NULL AND trim(k, {_WS}) <> '' GROUP BY ALL),
z AS (SELECT ref_table, n FROM rk WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.project = rk.project AND x.k = rk.k AND x.created_at IS NOT NULL AND x.deleted_at IS NULL)) SELECT ref_table, count(*) AS orphan_keys, CAST(sum(n) AS BIGINT) AS orphan_references FROM z GROUP BY 1""",
        "p4_intervals": _TREE + """, z AS (SELECT k.id, coalesce(t.root_id, -1) AS root_id, t.path FROM k LEFT JOIN t ON k.id = t.id), s AS (SELECT CAST(u.a AS BIGINT) AS id, count(*) AS n FROM (SELECT unnest(string_split(path, '/')) AS a FROM t) u GROUP BY 1)
SELECT z.id, z.root_id, s.n AS size, CASE WHEN z.path IS NOT NULL THEN 0 END AS strays FROM z LEFT JOIN s ON s.id = z.id""",
        "p6_report": _ORPHANS + "SELECT ref_table, ref_field, strftime(w, '%Y-%m') AS month, reason, count(*) AS orphans FROM o GROUP BY ALL",
    }
