"""Queries over resolution, cluster details and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.operators import history as H
from strataweave.operators import impact as I
from strataweave.operators import resolution as R
from strataweave.plans.bind import cte
from strataweave.plans.bind import view as V
from strataweave.plans.cut import cut
from strataweave.queries import graph as G
from strataweave.queries import history as Q


def call_resolution(s: SparkSession, d: str) -> DataFrame:
    n = V(s, d, "g_nodes")
    methods = n.where("label in ('Method', 'Function')")
    calls = n.where("label = 'Class'").select("project", F.col("qualified_name").alias("caller_qn"), F.element_at(F.array(F.lit("small ring"), F.lit("large bolt"), F.concat(F.lit("order_"), (F.col("id") - 10000000).cast("string"))), (F.col("id") % 3 + 1).cast("int")).alias("callee"), F.when(F.col("id") % 2 == 0, "none").when(F.col("id") % 5 == 0, "unknown").otherwise("resolved").alias("kind"), F.concat(F.lit("Cat.Brand#"), (F.col("id") % 25).cast("string")).alias("receiver"))
    return R.resolve_calls(calls, methods)


def import_resolution(s: SparkSession, d: str) -> DataFrame:
    n = V(s, d, "g_nodes").where("label = 'Class'")
    imports = n.select("project", F.col("file_path").alias("file_qn"), F.when(F.col("id") % 2 == 0, F.col("qualified_name")).otherwise("System.Text").alias("namespace"))
    return R.resolve_imports(imports, n)


def dto_projects(s: SparkSession, d: str) -> DataFrame:
    names = s.createDataFrame([("Orders.Api",), ("Orders.Api.Models",), ("orders.core",), ("X",)], "name string")
    t = V(s, d, "g_repos").select(F.element_at(F.array(*map(F.lit, ("Orders.Api.Models.Dto", "Orders.Api.Contracts.V1.Dto", "ORDERS.Core.Shared.Dto", "X.Dto", "Other.Thing.Dto"))), (F.col("age_days") % 5 + 1).cast("int")).alias("q")).select(F.col("q").alias("type_qn")).distinct()
    return R.dto_projects(t, names)


def vulnerable_packages(s: SparkSession, d: str) -> DataFrame:
    refs = V(s, d, "g_nodes").where("label = 'Service'").select("project", F.concat(F.lit("Pkg"), (F.col("id") % 3).cast("string")).alias("package"), F.concat_ws(".", (F.col("id") % 4).cast("string"), (F.col("id") % 11).cast("string")).alias("version"))
    adv = s.createDataFrame([("pkg0", "1.2", "2.10", "high"), ("PKG1", None, "1.0", "low"), ("pkg2", "3.0", None, "critical")], "package string, first_bad string, first_good string, severity string")
    return R.vulnerable_packages(refs, adv)


def cluster_members(s: SparkSession, d: str) -> DataFrame:
    return R.cluster_members(V(s, d, "g_cross"), G._regions(s, d))


def cluster_connections(s: SparkSession, d: str) -> DataFrame:
    return R.cluster_connections(V(s, d, "g_cross"), G._regions(s, d))


def fleet_health(s: SparkSession, d: str) -> DataFrame:
    m = Q._metrics(s, d).withColumn("brand", F.split("path", "/")[1])
    return R.fleet(H.health_summary(m, "brand"))


def impact_rollup(s: SparkSession, d: str) -> DataFrame:
    start = G._changed(s, d)
    hit = cut(I.affected(start, V(s, d, "g_nodes"), V(s, d, "g_edges"), V(s, d, "g_cross"), 2), "affected")
    return R.impact_rollup(hit, start, V(s, d, "g_cross"))


QUERIES = [call_resolution, import_resolution, dto_projects, vulnerable_packages, cluster_members, cluster_connections, fleet_health, impact_rollup]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    n = f"WITH {cte('g_nodes')} "
    rx = f"WITH {cte('g_repos', 'g_cross')}, l AS (SELECT lower(name) AS p, source_group AS c FROM g_repos), e AS (SELECT lower(source_project) AS s, lower(target_project) AS t, type, a.c AS cs, b.c AS ct FROM g_cross JOIN l a ON a.p = lower(source_project) JOIN l b ON b.p = lower(target_project)) "
    reached = G.oracle_sql()["impact_nodes"].rpartition("SELECT * FROM z")[0]
    health = Q.oracle_sql()["health_summary"]
    return {
        "call_resolution": n + ", c AS (SELECT project, qualified_name AS q, ['small ring', 'large bolt', 'order_' || (id - 10000000)][id % 3 + 1] AS callee, CASE WHEN id % 2 = 0 THEN 'none' WHEN id % 5 = 0 THEN 'unknown' ELSE 'resolved' END AS kind, 'Cat.Brand#' || id % 25 AS receiver FROM g_nodes WHERE label = 'Class'), t AS (SELECT DISTINCT project, name, qualified_name AS tq FROM g_nodes WHERE label IN ('Method', 'Function')), j AS (SELECT DISTINCT c.project, c.q, callee, kind, receiver, tq FROM c JOIN t ON t.project = c.project AND t.name = callee WHERE kind = 'none' OR kind = 'resolved' AND tq = receiver || '.' || string_split(tq, '.')[-1]), k AS (SELECT *, count(*) OVER (PARTITION BY project, q, callee, kind, receiver) AS n FROM j) SELECT DISTINCT project, q AS source_qn, tq AS target_qn, 'CALLS' AS type FROM k WHERE n = 1",
        "import_resolution": n + "SELECT DISTINCT project, file_path AS source_qn, qualified_name AS target_qn, 'IMPORTS' AS type FROM g_nodes WHERE label = 'Class' AND id % 2 = 0",
        "dto_projects": "SELECT * FROM (VALUES ('Orders.Api.Models.Dto', 'Orders.Api.Models'), ('Orders.Api.Contracts.V1.Dto', 'Orders.Api'), ('ORDERS.Core.Shared.Dto', 'orders.core')) v(type_qn, project)",
        "vulnerable_packages": n + ", r AS (SELECT project, 'Pkg' || id % 3 AS package, id % 4 AS a, id % 11 AS b FROM g_nodes WHERE label = 'Service') SELECT DISTINCT project, package, a || '.' || b AS version, CASE package WHEN 'Pkg0' THEN 'high' WHEN 'Pkg1' THEN 'low' ELSE 'critical' END AS severity FROM r WHERE package = 'Pkg0' AND ((a = 1 AND b >= 2) OR (a = 2 AND b < 10)) OR package = 'Pkg1' AND a < 1 OR package = 'Pkg2' AND a >= 3",
        "cluster_members": rx + "SELECT c AS community, p AS project, (SELECT count(*) FROM e WHERE cs = ct AND (s = p)) + (SELECT count(*) FROM e WHERE cs = ct AND t = p) AS internal, (SELECT count(*) FROM e WHERE cs <> ct AND s = p) + (SELECT count(*) FROM e WHERE cs <> ct AND t = p) AS external FROM l",
        "cluster_connections": rx + "SELECT community, other, count(*) AS edges, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM (SELECT cs AS community, ct AS other, type FROM e WHERE cs <> ct UNION ALL SELECT ct, cs, type FROM e WHERE cs <> ct) GROUP BY 1, 2",
        "fleet_health": f"SELECT count(*) AS repositories, round_even(avg(health), 1) AS average, CAST(sum(hotspots) AS BIGINT) AS hotspots, CAST(sum(alerts) AS BIGINT) AS alerts, count(*) FILTER (WHERE health < 4.0) AS below_4, count(*) FILTER (WHERE health < 2.5) AS below_2_5 FROM ({health})",
        "impact_rollup": reached + ", d AS (SELECT source_project, target_project, type AS edge_type, count(*) AS n FROM g_cross WHERE source_node_id IN (SELECT id FROM st) OR target_node_id IN (SELECT id FROM st) GROUP BY 1, 2, 3 UNION ALL SELECT (SELECT min(project) FROM st), project, 'TRANSITIVE', count(*) FROM z WHERE project NOT IN (SELECT project FROM st) GROUP BY 2) SELECT source_project, target_project, min(edge_type) AS edge_type, CAST(sum(n) AS BIGINT) AS nodes FROM d GROUP BY 1, 2",
    }
