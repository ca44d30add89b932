"""Queries over the code graph: store, walks, impact, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.operators import community as C
from strataweave.operators import impact as I
from strataweave.operators import store as S
from strataweave.operators import traverse as T
from strataweave.plans.bind import cte
from strataweave.plans.bind import view as V
from strataweave.plans.cut import cut

NODE = ["id", "project", "label", "name"]
CALLS = ["CALLS", "USES_TYPE", "HTTP_CALLS"]


def nodes_by_label(s: SparkSession, d: str) -> DataFrame:
    return S.by_label(V(s, d, "g_nodes"), "Route", 1000).select(*NODE)


def search_nodes(s: SparkSession, d: str) -> DataFrame:
    return S.page(S.search_nodes(V(s, d, "g_nodes"), "RING", label="Method", file="src/%"), ["name", "id"], 1, 50).select(*NODE, "file_path")


def search_nodes_count(s: SparkSession, d: str) -> DataFrame:
    return S.search_nodes(V(s, d, "g_nodes"), "order_1", project="NATION_3").agg(F.count("*").alias("n"))


def search_repositories(s: SparkSession, d: str) -> DataFrame:
    return S.search_repositories(V(s, d, "g_repos"), "nation_1*").select("name", "source_group", "language")


def edges_by_source_batch(s: SparkSession, d: str) -> DataFrame:
    ids = s.range(40000000, 40001500).select("id")
    return S.edges_of(V(s, d, "g_edges"), ids, "source_id", ["CALLS"]).select("source_id", "target_id", "type", F.round("confidence", 4).alias("confidence"))


def edges_touching_nodes(s: SparkSession, d: str) -> DataFrame:
    return S.edges_touching(V(s, d, "g_edges"), s.range(20000000, 20000004).select("id")).select("source_id", "target_id", "type")


def label_counts(s: SparkSession, d: str) -> DataFrame:
    return S.counts(V(s, d, "g_nodes"), "project", "label")


def dotnet_label_counts(s: SparkSession, d: str) -> DataFrame:
    return S.counts(V(s, d, "g_nodes").where("dotnet_project is not null"), "dotnet_project", "label")


def edge_type_counts(s: SparkSession, d: str) -> DataFrame:
    return S.counts(V(s, d, "g_edges"), "type")


def call_fan_in(s: SparkSession, d: str) -> DataFrame:
    return S.fan_in(V(s, d, "g_edges"), 20)


def repository_groups(s: SparkSession, d: str) -> DataFrame:
    return V(s, d, "g_repos").groupBy(F.lower("source_group").alias("key")).agg(F.min("source_group").alias("source_group"), F.count("*").alias("repositories"), F.count_if("is_foundational").alias("foundational"), F.countDistinct("language").alias("languages"))


def archival_candidates(s: SparkSession, d: str) -> DataFrame:
    return S.without_cross_edges(V(s, d, "g_repos"), V(s, d, "g_cross").where("type = 'HTTP_CALLS'")).select("name")


def stale_repositories(s: SparkSession, d: str) -> DataFrame:
    return V(s, d, "g_repos").where("age_days < 12").select("name", "age_days")


def classes_with_edges(s: SparkSession, d: str) -> DataFrame:
    return S.with_any_edge(V(s, d, "g_nodes"), V(s, d, "g_edges"), ["Class", "Service"]).select("id", "label")


def child_nodes(s: SparkSession, d: str) -> DataFrame:
    return S.children(V(s, d, "g_nodes"), V(s, d, "g_edges"))


def overview_edges(s: SparkSession, d: str) -> DataFrame:
    return S.overview_edges(V(s, d, "g_cross"))


def project_dependencies(s: SparkSession, d: str) -> DataFrame:
    return S.dependencies(V(s, d, "g_cross"))


def node_detail(s: SparkSession, d: str) -> DataFrame:
    return S.node_detail(V(s, d, "g_nodes"), V(s, d, "g_edges"), 20000001)


def unified_search(s: SparkSession, d: str) -> DataFrame:
    return S.unified_search(V(s, d, "g_repos"), V(s, d, "g_nodes"), "nation_2", 20)


def trust_ranked_search(s: SparkSession, d: str) -> DataFrame:
    n = V(s, d, "g_nodes")
    trust = n.where("id % 3 = 0").select("project", "file_path").distinct().withColumn("trust", (F.length("file_path") % 10) / 10)
    return S.trust_ranked(n, trust, "small ring", 15).select(*NODE, F.round("trust", 6).alias("trust"))


def _walk(s: SparkSession, d: str, start: int, direction: str, depth: int, **more) -> DataFrame:
    w = T.walk(s.createDataFrame([(start,)], "id long"), V(s, d, "g_edges"), direction, depth, CALLS, **more)
    return w.join(V(s, d, "g_nodes").select(F.col("id").alias("node_id"), "name"), "node_id").select("node_id", "name", "depth", "edge_type", "parent_id")


def traverse_outbound(s: SparkSession, d: str) -> DataFrame:
    return _walk(s, d, 40000001, "outbound", 4)


def traverse_inbound(s: SparkSession, d: str) -> DataFrame:
    return _walk(s, d, 20000001, "inbound", 3)


def traverse_both(s: SparkSession, d: str) -> DataFrame:
    return _walk(s, d, 40000001, "both", 3)


def traverse_min_confidence(s: SparkSession, d: str) -> DataFrame:
    return _walk(s, d, 40000001, "both", 3, confidence=0.7)


def traverse_visited(s: SparkSession, d: str) -> DataFrame:
    return _walk(s, d, 40000001, "both", 4, visited=True)


def find_consumers(s: SparkSession, d: str) -> DataFrame:
    n = V(s, d, "g_nodes")
    return T.one_hop(n, V(s, d, "g_edges"), n.where("name = 'small ring'"), ["CONSUMES", "CALLS", "HTTP_CALLS", "USES_TYPE", "HANDLES"])


def find_publishers(s: SparkSession, d: str) -> DataFrame:
    n = V(s, d, "g_nodes")
    return T.one_hop(n, V(s, d, "g_edges"), n.where("name = 'Supplier#000000003'"), ["PUBLISHES", "USES_TYPE"])


def call_path(s: SparkSession, d: str) -> DataFrame:
    n = V(s, d, "g_nodes")
    start = cut(T.first_of(n, "small ring", ["Method", "Function"]), "start")
    return T.walk(start, V(s, d, "g_edges"), "inbound", 3, ["CALLS", "HTTP_CALLS"])


def data_lineage(s: SparkSession, d: str) -> DataFrame:
    n, e = V(s, d, "g_nodes"), V(s, d, "g_edges")
    start = cut(T.first_of(n, "Supplier#000000003", ["Class", "Record", "Interface"]), "start")
    types = ["USES_TYPE", "PUBLISHES", "CONSUMES", "HTTP_CALLS"]
    return T.walk(start, e, "outbound", 4, types).withColumn("way", F.lit("downstream")).unionByName(T.walk(start, e, "inbound", 4, types).withColumn("way", F.lit("upstream")))


def architecture_hotspots(s: SparkSession, d: str) -> DataFrame:
    hot = S.fan_in(V(s, d, "g_edges"), 3).join(V(s, d, "g_nodes").where("label in ('Method', 'Function')").select(F.col("id").alias("target_id"), "project", "name"), "target_id")
    return hot.orderBy(F.desc("callers"), "target_id").limit(10)


def _changed(s: SparkSession, d: str) -> DataFrame:
    return cut(V(s, d, "g_nodes").where("id in (20000001, 20000004, 30000007)").select("id", "project"), "changed")


def impact_nodes(s: SparkSession, d: str) -> DataFrame:
    return I.affected(_changed(s, d), V(s, d, "g_nodes"), V(s, d, "g_edges"), V(s, d, "g_cross"), 2)


def impact_summary(s: SparkSession, d: str) -> DataFrame:
    return impact_nodes(s, d).groupBy("risk", "depth").agg(F.count("*").alias("affected"), F.countDistinct("project").alias("projects"))


def blast_radius_2hop(s: SparkSession, d: str) -> DataFrame:
    n = V(s, d, "g_nodes")
    spans = s.createDataFrame([("SRC/svc/3.cs", 10, 12), ("src/svc/4.cs", 60, 61)], "file_path string, from_line int, to_line int")
    start = cut(I.overlapping(n, spans).select("id"), "spans")
    w = T.walk(start, V(s, d, "g_edges"), "both", 2, visited=True).select("node_id", "depth").distinct()
    return w.join(n.select(F.col("id").alias("node_id"), "project", "file_path"), "node_id").groupBy("project", "file_path").agg(F.min("depth").alias("depth"), F.count("*").alias("nodes"))


def weighted_adjacency(s: SparkSession, d: str) -> DataFrame:
    return C.adjacency(V(s, d, "g_cross")).select("a", "b", F.round("weight", 6).alias("weight"))


def _regions(s: SparkSession, d: str) -> DataFrame:
    return V(s, d, "g_repos").select(F.lower("name").alias("project"), F.col("source_group").alias("community"))


def modularity_by_region(s: SparkSession, d: str) -> DataFrame:
    return C.modularity(C.adjacency(V(s, d, "g_cross")), _regions(s, d))


def cluster_summary(s: SparkSession, d: str) -> DataFrame:
    return C.cluster_summary(V(s, d, "g_cross"), _regions(s, d))


def cluster_graph(s: SparkSession, d: str) -> DataFrame:
    few = V(s, d, "g_repos").where("age_days < 20").select(F.lower("name").alias("project"), (F.col("age_days") % 4 + 1).alias("community"))
    return C.cluster_graph(V(s, d, "g_cross"), few)


def louvain_clusters(s: SparkSession, d: str) -> DataFrame:
    return C.louvain(C.adjacency(V(s, d, "g_cross")))


def betweenness(s: SparkSession, d: str) -> DataFrame:
    return C.betweenness(C.adjacency(V(s, d, "g_cross")))


QUERIES = [
    nodes_by_label, search_nodes, search_nodes_count, search_repositories, edges_by_source_batch, edges_touching_nodes, label_counts, dotnet_label_counts, edge_type_counts, call_fan_in, repository_groups,
    stale_repositories, classes_with_edges, child_nodes, overview_edges, project_dependencies, node_detail, unified_search, trust_ranked_search, traverse_outbound, traverse_inbound, traverse_both,
    traverse_min_confidence, traverse_visited, find_consumers, find_publishers, call_path, data_lineage, architecture_hotspots, impact_nodes, impact_summary, blast_radius_2hop, weighted_adjacency, modularity_by_region,
    cluster_summary, cluster_graph, louvain_clusters, betweenness, archival_candidates,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_IN = "', '".join


def _moves(direction: str, floor: str = "") -> str:
    out = f"SELECT source_id AS src, target_id AS dst, type FROM g_edges WHERE type IN ('{_IN(CALLS)}'){floor}"
    back = f"SELECT target_id AS src, source_id AS dst, type FROM g_edges WHERE type IN ('{_IN(CALLS)}'){floor}"
    return {"outbound": out, "inbound": back, "both": f"{out} UNION ALL {back}"}[direction]


def _walk_sql(start: int, direction: str, depth: int, floor: str = "") -> str:
    return f"""WITH RECURSIVE {cte("g_nodes", "g_edges")}, mv AS ({_moves(direction, floor)}),
w AS (SELECT dst AS node_id, 1 AS depth, type AS edge_type, src AS parent_id FROM mv WHERE src = {start}
  UNION SELECT mv.dst, w.depth + 1, mv.type, mv.src FROM w JOIN mv ON mv.src = w.node_id WHERE w.depth < {depth})
SELECT DISTINCT node_id, name, CAST(depth AS INT) AS depth, edge_type, parent_id FROM w JOIN g_nodes ON id = node_id"""


def oracle_sql() -> dict[str, str]:
    n, e, x, r = (f"WITH {cte(v)} " for v in ("g_nodes", "g_edges", "g_cross", "g_repos"))
    ne, rx = f"WITH {cte('g_nodes', 'g_edges')} ", f"WITH {cte('g_repos', 'g_cross')} "
    hop = "SELECT min(id) AS id, arg_min(name, id) AS name, qualified_name, arg_min(project, id) AS project, arg_min(label, id) AS label FROM g_nodes WHERE id IN (SELECT source_id FROM g_edges WHERE target_id IN (SELECT id FROM g_nodes WHERE name = '{0}') AND type IN ({1})) GROUP BY qualified_name"
    visited = f"""WITH {cte("g_nodes", "g_edges")}, mv AS ({_moves("both")}),
h1 AS (SELECT DISTINCT dst, type, src FROM mv WHERE src = 40000001 AND dst <> 40000001), s1 AS (SELECT 40000001 AS i UNION SELECT dst FROM h1),
h2 AS (SELECT DISTINCT dst, type, src FROM mv WHERE src IN (SELECT dst FROM h1) AND dst NOT IN (SELECT i FROM s1)), s2 AS (SELECT i FROM s1 UNION SELECT dst FROM h2),
h3 AS (SELECT DISTINCT dst, type, src FROM mv WHERE src IN (SELECT dst FROM h2) AND dst NOT IN (SELECT i FROM s2)), s3 AS (SELECT i FROM s2 UNION SELECT dst FROM h3),
h4 AS (SELECT DISTINCT dst, type, src FROM mv WHERE src IN (SELECT dst FROM h3) AND dst NOT IN (SELECT i FROM s3)),
h AS (SELECT 1 AS depth, * FROM h1 UNION ALL SELECT 2, * FROM h2 UNION ALL SELECT 3, * FROM h3 UNION ALL SELECT 4, * FROM h4)
SELECT dst AS node_id, name, depth, type AS edge_type, src AS parent_id FROM h JOIN g_nodes ON id = dst"""
    adj = "adj AS (SELECT least(s, t) AS a, greatest(s, t) AS b, sum(w) * CASE WHEN count(*) = 2 THEN 1.5 ELSE 1.0 END AS weight FROM (SELECT lower(source_project) AS s, lower(target_project) AS t, sum(CASE type WHEN 'PUBLISHES' THEN 3.0 WHEN 'CONSUMES' THEN 3.0 WHEN 'HTTP_CALLS' THEN 2.0 ELSE 1.0 END) AS w FROM g_cross GROUP BY 1, 2) WHERE s <> t GROUP BY 1, 2)"
    impact = f"""WITH {cte("g_nodes", "g_edges", "g_cross")}, st AS (SELECT id, project FROM g_nodes WHERE id IN (20000001, 20000004, 30000007)),
mv AS (SELECT target_id AS src, source_id AS dst, type FROM g_edges WHERE type IN ('{_IN(I.DEPENDENCY)}')),
f1 AS (SELECT dst AS id, min(ROW(type, project)) AS m FROM st JOIN mv ON src = st.id WHERE dst NOT IN (SELECT id FROM st) GROUP BY 1), k1 AS (SELECT id FROM st UNION SELECT id FROM f1),
f2 AS (SELECT dst AS id, min(ROW(type, m[2])) AS m FROM f1 JOIN mv ON src = f1.id WHERE dst NOT IN (SELECT id FROM k1) GROUP BY 1),
v AS (SELECT id, 0 AS depth FROM st UNION ALL SELECT id, 1 FROM f1 UNION ALL SELECT id, 2 FROM f2),
nx AS (SELECT * FROM g_cross WHERE source_project IN (SELECT project FROM st) OR target_project IN (SELECT project FROM st)),
o AS (SELECT source_node_id AS id, v.depth + 1 AS depth, type, target_project AS p FROM nx JOIN v ON v.id = target_node_id UNION ALL SELECT target_node_id, v.depth + 1, type, source_project FROM nx JOIN v ON v.id = source_node_id),
s AS (SELECT id, min(ROW(depth, type, p)) AS m FROM o WHERE depth <= 2 AND id NOT IN (SELECT id FROM v) GROUP BY 1),
g AS (SELECT dst AS id, min(ROW(type, m[3])) AS m FROM s JOIN mv ON src = s.id WHERE m[1] = 1 AND dst NOT IN (SELECT id FROM v UNION SELECT id FROM s) GROUP BY 1),
a AS (SELECT id, 1 AS depth, m[1] AS edge_type, m[2] AS p FROM f1 UNION ALL SELECT id, 2, m[1], m[2] FROM f2 UNION ALL SELECT id, m[1], m[2], m[3] FROM s UNION ALL SELECT id, 2, m[1], m[2] FROM g),
sc AS (SELECT a.id, n.project, CAST(depth AS INT) AS depth, edge_type, n.project <> p AS c,
    CASE WHEN depth = 1 AND edge_type IN ('{_IN(I.CROSSING)}') AND n.project <> p THEN 0 ELSE least(depth, 3) - CAST(n.project <> p AS INT) - CAST(edge_type IN ('CONSUMES', 'PUBLISHES') AS INT) END
    + CASE WHEN contains(lower(file_path), 'test') OR contains(lower(file_path), 'spec') OR contains(lower(coalesce(dotnet_project, '')), 'test') THEN 1 ELSE 0 END AS k FROM a JOIN g_nodes n ON n.id = a.id),
z AS (SELECT id, project, depth, edge_type, CASE WHEN k <= 0 THEN 'Critical' WHEN k = 1 THEN 'High' WHEN k = 2 THEN 'Medium' ELSE 'Low' END AS risk FROM sc) """
    lineage = "SELECT dst AS node_id, CAST(depth AS INT) AS depth, type AS edge_type, src AS parent_id, '{2}' AS way FROM {0}"
    types = "('USES_TYPE', 'PUBLISHES', 'CONSUMES', 'HTTP_CALLS')"
    return {
        "nodes_by_label": n + "SELECT id, project, label, name FROM g_nodes WHERE label = 'Route' ORDER BY id LIMIT 1000",
        "search_nodes": n + "SELECT id, project, label, name, file_path FROM g_nodes WHERE lower(name) LIKE '%ring%' AND label = 'Method' AND lower(file_path) LIKE '%src/%%' ORDER BY name, id LIMIT 50",
        "search_nodes_count": n + "SELECT count(*) AS n FROM g_nodes WHERE name ILIKE '%order_1%' AND project = 'NATION_3'",
        "search_repositories": r + "SELECT name, source_group, language FROM g_repos WHERE lower(name) LIKE 'nation_1%'",
        "edges_by_source_batch": e + "SELECT source_id, target_id, type, round(confidence, 4) AS confidence FROM g_edges WHERE type = 'CALLS' AND source_id BETWEEN 40000000 AND 40001499",
        "edges_touching_nodes": e + "SELECT DISTINCT source_id, target_id, type FROM g_edges WHERE source_id BETWEEN 20000000 AND 20000003 OR target_id BETWEEN 20000000 AND 20000003",
        "label_counts": n + "SELECT project, label, count(*) AS n FROM g_nodes GROUP BY ALL",
        "dotnet_label_counts": n + "SELECT dotnet_project, label, count(*) AS n FROM g_nodes WHERE dotnet_project IS NOT NULL GROUP BY ALL",
        "edge_type_counts": e + "SELECT type, count(*) AS n FROM g_edges GROUP BY ALL",
        "call_fan_in": e + "SELECT target_id, count(*) AS callers FROM g_edges WHERE type = 'CALLS' GROUP BY 1 HAVING count(*) >= 20",
        "repository_groups": r + "SELECT lower(source_group) AS key, min(source_group) AS source_group, count(*) AS repositories, count(*) FILTER (WHERE is_foundational) AS foundational, count(DISTINCT language) AS languages FROM g_repos GROUP BY 1",
        "archival_candidates": rx + "SELECT name FROM g_repos WHERE NOT EXISTS (SELECT 1 FROM g_cross WHERE type = 'HTTP_CALLS' AND (source_project = name OR target_project = name))",
        "stale_repositories": r + "SELECT name, age_days FROM g_repos WHERE age_days < 12",
        "classes_with_edges": ne + "SELECT id, label FROM g_nodes WHERE label IN ('Class', 'Service') AND id IN (SELECT source_id FROM g_edges UNION SELECT target_id FROM g_edges)",
        "child_nodes": ne + "SELECT source_id AS parent_id, target_id AS child_id, name AS child_name FROM g_edges JOIN g_nodes ON id = target_id WHERE type IN ('DEFINES', 'DEFINES_METHOD')",
        "overview_edges": x + "SELECT source_project, target_project, type, count(*) AS of_type, CAST(sum(count(*)) OVER (PARTITION BY source_project, target_project) AS BIGINT) AS total FROM g_cross GROUP BY 1, 2, 3",
        "project_dependencies": x + "SELECT coalesce(a.p, b.p) AS project, coalesce(o, 0) AS outbound, coalesce(dd, 0) AS depends_on, ts AS targets, coalesce(i, 0) AS inbound, coalesce(u, 0) AS used_by FROM (SELECT source_project AS p, count(*) AS o, count(DISTINCT target_project) AS dd, string_agg(DISTINCT target_project, ',' ORDER BY target_project) AS ts FROM g_cross GROUP BY 1) a FULL JOIN (SELECT target_project AS p, count(*) AS i, count(DISTINCT source_project) AS u FROM g_cross GROUP BY 1) b ON a.p = b.p",
        "node_detail": ne + "SELECT w.direction, w.type, w.o AS other_id, n.name AS other_name, n.project AS other_project, n.project <> (SELECT project FROM g_nodes WHERE id = 20000001) AS is_cross FROM (SELECT 'out' AS direction, type, target_id AS o FROM g_edges WHERE source_id = 20000001 UNION ALL SELECT 'in', type, source_id FROM g_edges WHERE target_id = 20000001) w JOIN g_nodes n ON n.id = w.o",
        "unified_search": f"WITH {cte('g_repos', 'g_nodes')} SELECT kind, name, id FROM (SELECT 'repository' AS kind, name, CAST(0 AS BIGINT) AS id FROM g_repos WHERE lower(name) LIKE '%nation_2%' UNION ALL SELECT 'node', name, id FROM g_nodes WHERE lower(name) LIKE '%nation_2%') ORDER BY lower(name) <> 'nation_2', kind <> 'repository', name, id LIMIT 20",
        "trust_ranked_search": n + ", t AS (SELECT DISTINCT project, file_path, length(file_path) % 10 / 10.0 AS trust FROM g_nodes WHERE id % 3 = 0), f AS (SELECT id, n.project, label, name, coalesce(CAST(trust AS DOUBLE), 0.5) AS trust FROM g_nodes n LEFT JOIN t ON t.project = n.project AND t.file_path = n.file_path WHERE lower(name) LIKE '%small ring%' ORDER BY name, id LIMIT 30) SELECT id, project, label, name, trust FROM f ORDER BY lower(name) <> 'small ring', trust DESC, name, id LIMIT 15",
        "traverse_outbound": _walk_sql(40000001, "outbound", 4),
        "traverse_inbound": _walk_sql(20000001, "inbound", 3),
        "traverse_both": _walk_sql(40000001, "both", 3),
        "traverse_min_confidence": _walk_sql(40000001, "both", 3, " AND (confidence IS NULL OR CAST(confidence AS DECIMAL(10,4)) >= 0.7)"),
        "traverse_visited": visited,
        "find_consumers": ne + hop.format("small ring", "'CONSUMES', 'CALLS', 'HTTP_CALLS', 'USES_TYPE', 'HANDLES'"),
        "find_publishers": ne + hop.format("Supplier#000000003", "'PUBLISHES', 'USES_TYPE'"),
        "call_path": f"""WITH RECURSIVE {cte("g_nodes", "g_edges")}, st AS (SELECT id FROM g_nodes WHERE lower(name) = 'small ring' ORDER BY label NOT IN ('Method', 'Function'), id LIMIT 1), mv AS (SELECT target_id AS src, source_id AS dst, type FROM g_edges WHERE type IN ('CALLS', 'HTTP_CALLS')),
w AS (SELECT dst, 1 AS depth, type, src FROM mv JOIN st ON src = id UNION SELECT mv.dst, depth + 1, mv.type, mv.src FROM w JOIN mv ON mv.src = w.dst WHERE depth < 3) SELECT dst AS node_id, CAST(depth AS INT) AS depth, type AS edge_type, src AS parent_id FROM w""",
        "data_lineage": f"""WITH RECURSIVE {cte("g_nodes", "g_edges")}, st AS (SELECT id FROM g_nodes WHERE name = 'Supplier#000000003' ORDER BY id LIMIT 1),
dn AS (SELECT target_id AS dst, 1 AS depth, type, source_id AS src FROM g_edges JOIN st ON source_id = id WHERE type IN {types} UNION SELECT e.target_id, depth + 1, e.type, e.source_id FROM dn JOIN g_edges e ON e.source_id = dn.dst WHERE depth < 4 AND e.type IN {types}),
up AS (SELECT source_id AS dst, 1 AS depth, type, target_id AS src FROM g_edges JOIN st ON target_id = id WHERE type IN {types} UNION SELECT e.source_id, depth + 1, e.type, e.target_id FROM up JOIN g_edges e ON e.target_id = up.dst WHERE depth < 4 AND e.type IN {types})
{lineage.format("dn", "", "downstream")} UNION ALL {lineage.format("up", "", "upstream")}""",
        "architecture_hotspots": ne + "SELECT target_id, callers, project, name FROM (SELECT target_id, count(*) AS callers FROM g_edges WHERE type = 'CALLS' GROUP BY 1 HAVING count(*) >= 3) JOIN g_nodes ON id = target_id WHERE label IN ('Method', 'Function') ORDER BY callers DESC, target_id LIMIT 10",
        "impact_nodes": impact + "SELECT * FROM z",
        "impact_summary": impact + "SELECT risk, depth, count(*) AS affected, count(DISTINCT project) AS projects FROM z GROUP BY 1, 2",
        "blast_radius_2hop": f"""WITH {cte("g_nodes", "g_edges")}, st AS (SELECT id FROM g_nodes WHERE (lower(file_path) = 'src/svc/3.cs' AND start_line <= 12 AND end_line >= 10) OR (lower(file_path) = 'src/svc/4.cs' AND start_line <= 61 AND end_line >= 60)),
mv AS (SELECT source_id AS src, target_id AS dst FROM g_edges UNION SELECT target_id, source_id FROM g_edges), h1 AS (SELECT DISTINCT dst FROM mv WHERE src IN (SELECT id FROM st) AND dst NOT IN (SELECT id FROM st)),
h2 AS (SELECT DISTINCT dst FROM mv WHERE src IN (SELECT dst FROM h1) AND dst NOT IN (SELECT id FROM st UNION SELECT dst FROM h1)), h AS (SELECT dst, 1 AS depth FROM h1 UNION ALL SELECT dst, 2 FROM h2)
SELECT project, file_path, CAST(min(depth) AS INT) AS depth, count(*) AS nodes FROM h JOIN g_nodes ON id = dst GROUP BY 1, 2""",
        "weighted_adjacency": x + f", {adj} SELECT a, b, round(CAST(weight AS DOUBLE), 6) AS weight FROM adj",
        "modularity_by_region": rx + f", {adj}, l AS (SELECT lower(name) AS p, source_group AS c FROM g_repos), m AS (SELECT sum(weight) AS m FROM adj), k AS (SELECT c, sum(weight) AS tot FROM (SELECT a AS p, weight FROM adj UNION ALL SELECT b, weight FROM adj) JOIN l USING (p) GROUP BY 1), i AS (SELECT la.c, sum(weight) AS win FROM adj JOIN l la ON la.p = a JOIN l lb ON lb.p = b WHERE la.c = lb.c GROUP BY 1) SELECT round(CAST(sum(coalesce(win, 0) / m - (tot / (2 * m)) * (tot / (2 * m))) AS DOUBLE), 6) AS modularity FROM k LEFT JOIN i USING (c), m",
        "cluster_summary": rx + ", l AS (SELECT lower(name) AS p, source_group AS c FROM g_repos), t AS (SELECT la.c AS cs, lb.c AS ct FROM g_cross LEFT JOIN l la ON la.p = lower(source_project) LEFT JOIN l lb ON lb.p = lower(target_project)), z AS (SELECT c AS community, count(*) AS members FROM l GROUP BY 1), w AS (SELECT z.*, (SELECT count(*) FROM t WHERE cs = community AND ct = community) AS internal, (SELECT count(*) FROM t WHERE (cs = community) <> (ct = community)) AS external FROM z) SELECT community, members, internal, external, round(CASE WHEN members > 1 THEN internal / (members * (members - 1) // 2) ELSE 0.0 END, 6) AS density FROM w",
        "cluster_graph": rx + ", l AS (SELECT lower(name) AS p, age_days % 4 + 1 AS c FROM g_repos WHERE age_days < 20) SELECT coalesce(la.c, 0) AS source_cluster, coalesce(lb.c, 0) AS target_cluster, count(*) AS edges, coalesce(la.c, 0) <> coalesce(lb.c, 0) AS is_cross FROM g_cross LEFT JOIN l la ON la.p = lower(source_project) LEFT JOIN l lb ON lb.p = lower(target_project) GROUP BY 1, 2, 4",
    }
