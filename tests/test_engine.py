from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strataweave.engine import Engine
from strataweave.operators import resolution as R

NODES = "id long, project string, dotnet_project string, label string, name string, qualified_name string, file_path string, start_line int, end_line int"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(1, "A", None, "Method", "run", "a.run", "src/a.cs", 1, 9), (2, "A", None, "Method", "stop", "a.stop", "src/a.cs", 10, 19), (3, "B", None, "Class", "Job", "b.Job", "src/b.cs", 1, 9), (4, "B", None, "Method", "run", "b.Job.run", "src/b.cs", 2, 5)]
    t = datetime(2024, 1, 1)
    return Engine(
        {
            "nodes": spark.createDataFrame(rows, NODES), "edges": spark.createDataFrame([(1, 2, "CALLS", None), (4, 2, "CALLS", 0.4), (3, 4, "DEFINES_METHOD", None)], "source_id long, target_id long, type string, confidence double"),
            "cross": spark.createDataFrame([("A", "B", 1, 3, "HTTP_CALLS")], "source_project string, target_project string, source_node_id long, target_node_id long, type string"),
            "repositories": spark.createDataFrame([("A", "g"), ("B", "g"), ("C", None)], "name string, source_group string"),
            "claims": spark.createDataFrame([("u", 1, "c_1", "wallet is late", "is", "late", "active", t, "g"), ("v", 2, "c_2", "wallet", "is", "x", "active", t, "g")], "username string, claim_id long, external_id string, normalized_text string, predicate string, value_text string, status string, recorded_at timestamp, fact_group string"),
            "chunks": spark.createDataFrame([("k1", "Rules", "use the wallet service"), ("k2", "Other", "nothing")], "key string, title string, text string"),
            "files": spark.createDataFrame([("a.cs", "1\n2\n3")], "path string, content string"),
        },
        username="u",
    )


def test_questions(engine):
    ids = lambda df, c="id": {r[c] for r in df.collect()}
    assert ids(engine.ask("search_graph", pattern="RUN")) == {1, 4}
    assert ids(engine.ask("trace_call_path", name="run"), "node_id") == {2}
    assert ids(engine.ask("trace_call_path", name="stop", direction="inbound", confidence=0.5), "node_id") == {1}
    assert ids(engine.ask("find_consumers", name="stop")) == {1, 4}
    assert ids(engine.ask("find_archival_candidates"), "name") == {"C"}
    assert {(r["id"], r["risk"]) for r in engine.ask("analyze_impact", name="stop", depth=2).collect()} >= {(1, "High")}
    assert ids(engine.ask("search_memory", query="wallet"), "claim_id") == {1}
    assert ids(engine.ask("search_conventions", query="wallet"), "key") == {"k1"}
    assert ids(engine.ask("get_code_snippet", path="a.cs", first=2, last=2), "text") == {"2"}
    assert engine.ask("get_graph_schema").count() == 4 and engine.ask("list_projects", group="G").count() == 2
    assert engine.ask("get_service_clusters").count() >= 1
    with pytest.raises(ValueError):
        engine.ask("drop_everything")
    with pytest.raises(KeyError):
        engine.ask("memory_diagnostics", cutoff=datetime(2024, 1, 1))
    assert len(engine.questions()) >= 30


def test_resolution_edges(spark):
    n = spark.createDataFrame([("p", "f", "A.f"), ("p", "f", "B.f"), ("p", "g", "g"), (None, "f", "x")], "project string, name string, qualified_name string")
    calls = spark.createDataFrame([("p", "c", "f", "none", None), ("p", "c", "f", "resolved", "A"), ("p", "c", "g", "none", None), ("p", "c", "f", "unknown", "A"), ("p", "c", "f", "resolved", None), ("p", "c", None, "none", None)], "project string, caller_qn string, callee string, kind string, receiver string")
    assert sorted(r["target_qn"] for r in R.resolve_calls(calls, n).collect()) == ["A.f", "g"]
    assert R.resolve_calls(calls.limit(0), n).count() == 0
    refs = spark.createDataFrame([("p", "X", "1.9.0"), ("p", "x", "1.10"), ("p", "x", None), ("p", "y", "1")], "project string, package string, version string")
    adv = spark.createDataFrame([("x", None, "1.10.0", "high")], "package string, first_bad string, first_good string, severity string")
    assert [r["version"] for r in R.vulnerable_packages(refs, adv).collect()] == ["1.9.0"]
    row = spark.range(1).select(R.diagnostic_key(F.lit(None), F.lit(" CS1 "), F.lit("a"), F.lit(1), F.lit(None), F.lit("m"))).first()[0]
    assert row.startswith("CS1|") and len(row) == 68
    nodes = spark.createDataFrame([(1, "a/b", "Folder"), (2, "a/b/c.cs", "File"), (3, "z", "Folder")], "id long, file_path string, label string")
    edges = spark.createDataFrame([(2, 9), (9, 2), (8, 9)], "source_id long, target_id long")
    inside, touching = R.slice_closure(nodes, edges, nodes.where("id = 2"))
    assert {r["id"] for r in inside.collect()} == {1, 2} and touching.count() == 2
    old = spark.createDataFrame([("a", "Knows", "b", None, datetime(2024, 1, 1)), ("a", "Knows", "b", None, datetime(2024, 1, 2))], "from_id string, type string, to_id string, context string, at timestamp")
    new = R.legacy_claims(old, spark.createDataFrame([], "claim_id string"))
    assert new.count() == 1 and R.legacy_claims(old, new).count() == 0
