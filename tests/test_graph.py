from strataweave.operators import community as C
from strataweave.operators import impact as I
from strataweave.operators import store as S
from strataweave.operators import traverse as T
from strataweave.queries import graph

EDGES = "source_id long, target_id long, type string, confidence double"
NODES = "id long, project string, dotnet_project string, label string, name string, qualified_name string, file_path string, start_line int, end_line int"
CROSS = "source_project string, target_project string, source_node_id long, target_node_id long, type string"


def edges(spark, *pairs, type="CALLS"):
    return spark.createDataFrame([(a, b, type, None) for a, b in pairs], EDGES)


def walk(spark, e, **k):
    return {(r["node_id"], r["depth"]) for r in T.walk(spark.createDataFrame([(1,)], "id long"), e, "outbound", 4, **k).collect()}


def test_walk_may_return_but_visited_may_not(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 1), (3, 4))
    assert walk(spark, e) == {(2, 1), (3, 2), (1, 3), (4, 3), (2, 4)}
    assert walk(spark, e, visited=True) == {(2, 1), (3, 2), (4, 3)}
    assert walk(spark, e.limit(0)) == set()


def test_confidence_floor_lets_unknown_pass(spark):
    e = spark.createDataFrame([(1, 2, "CALLS", 0.5), (1, 3, "CALLS", None), (1, 4, "CALLS", 0.7)], EDGES)
    assert walk(spark, e, confidence=0.7) == {(3, 1), (4, 1)}


def test_louvain_two_triangles_and_bridge(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    cross = spark.createDataFrame([(x, y, 1, 2, "HTTP_CALLS") for x, y in pairs], CROSS)
    adj = C.adjacency(cross)
    labels = C.louvain(adj)
    groups = {}
    for r in labels.collect():
        groups.setdefault(r["community"], set()).add(r["project"])
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["d", "e", "f"]]
    between = {r["project"]: r["centrality"] for r in C.betweenness(adj).collect()}
    assert between["c"] == between["d"] == max(between.values()) and between["a"] == 0.0
    assert abs(C.modularity(adj, labels).first()["modularity"] - (6 / 7 - 0.5)) < 1e-6
    assert C.louvain(adj.limit(0)).count() == 0 and C.betweenness(adj.limit(0)).count() == 0


def test_adjacency_weights_and_both_ways(spark):
    cross = spark.createDataFrame([("A", "b", 1, 2, "PUBLISHES"), ("b", "a", 2, 1, "OTHER"), ("b", "c", 1, 3, "HTTP_CALLS"), ("a", "A", 1, 1, "CALLS")], CROSS)
    assert sorted(map(tuple, C.adjacency(cross).collect())) == [("a", "b", 6.0), ("b", "c", 2.0)]


def test_impact_across_repositories(spark):
    nodes = spark.createDataFrame([(1, "p", None, "Event", "e", "e", "src/e.cs", 1, 2), (2, "q", None, "Class", "c", "c", "src/c.cs", 1, 2), (3, "p", None, "Method", "m", "m", "src/m.cs", 1, 2), (4, "p", None, "Method", "t", "t", "tests/t.cs", 1, 2)], NODES)
    e = edges(spark, (3, 1), (4, 1))
    cross = spark.createDataFrame([("q", "p", 2, 1, "PUBLISHES")], CROSS)
    got = {r["id"]: (r["depth"], r["risk"]) for r in I.affected(nodes.where("id = 1").select("id", "project"), nodes, e, cross, 3).collect()}
    assert got == {2: (1, "Critical"), 3: (1, "High"), 4: (1, "Medium")}


def test_overlapping_spans(spark):
    nodes = spark.createDataFrame([(1, "p", None, "M", "a", "a", "A.cs", 1, 5), (2, "p", None, "M", "b", "b", "a.cs", 6, 9), (3, "p", None, "M", "c", "c", "a.cs", None, None), (4, "p", None, "M", "d", "d", "b.cs", 1, 9)], NODES)
    spans = spark.createDataFrame([("a.cs", 5, 5)], "file_path string, from_line int, to_line int")
    assert {r["id"] for r in I.overlapping(nodes, spans).collect()} == {1, 3}


def test_store_searches(spark):
    repos = spark.createDataFrame([("Core-Api", "g"), ("core", "h"), ("other", None)], "name string, source_group string")
    assert {r["name"] for r in S.search_repositories(repos, "CORE").collect()} == {"Core-Api", "core"}
    assert {r["name"] for r in S.search_repositories(repos, "core*", "h").collect()} == {"core"}
    cross = spark.createDataFrame([("CORE", "x", 1, 2, "CALLS")], CROSS)
    assert {r["name"] for r in S.without_cross_edges(repos, cross).collect()} == {"Core-Api", "other"}
    assert S.page(repos, ["name"], 0, 1000).count() == 3 and S.page(repos, ["name"], 2, 2).count() == 1
    assert [r[0] for r in repos.limit(1).select(S.severity_rank(S.F.lit("HIGH"))).collect()] == [1]


def test_graph_queries_take_every_cross_edge(spark, monkeypatch):
    cross = spark.createDataFrame([("A", "b", 1, 2, "HTTP_CALLS"), ("b", "c", 3, 4, "REFERENCES_PACKAGE")], CROSS)
    repos = spark.createDataFrame([(x, "g") for x in ("A", "b", "c", "d")], "name string, source_group string")
    monkeypatch.setattr(graph, "V", lambda s, d, name: {"g_cross": cross, "g_repos": repos}[name])
    assert {r["project"]: r["centrality"] for r in graph.betweenness(spark, "").collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}
    assert {r["project"] for r in graph.louvain_clusters(spark, "").collect()} == {"a", "b", "c"}
    assert {r["name"] for r in graph.archival_candidates(spark, "").collect()} == {"c", "d"}
