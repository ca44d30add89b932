from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from strataweave.operators import extract as X
from strataweave.operators import logs as G
from strataweave.operators import memory_graph as MG
from strataweave.sources import catalog as C
from strataweave.sources import files as S
from strataweave.sources import gitlog as L


def test_scan_and_window(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a" / "x.py").write_text("one\ntwo\nthree\n")
    (tmp_path / "a" / "x.md").write_text("no")
    (tmp_path / "a" / "big.cs").write_text("x" * (S.MAX_BYTES + 1))
    (tmp_path / "node_modules" / "y.js").write_text("no")
    got = S.scan(spark, str(tmp_path)).collect()
    assert [(r["path"], r["content"]) for r in got] == [("a/x.py", "one\ntwo\nthree\n")]
    df = spark.createDataFrame([("a.cs", "1\n2\n3\n4\n5")], "path string, content string")
    assert [r["line"] for r in S.window(df, "a.cs", 2, 3).orderBy("line").collect()] == [2, 3]
    assert S.window(df, "a.cs", 2, 2, around=1).count() == 5
    with pytest.raises(ValueError):
        S.window(df, "../a.cs", 1, 1)
    there, gone = S.listed(df, spark.createDataFrame([("a.cs",), ("b.cs",)], "path string"))
    assert there.count() == 1 and gone.first()["path"] == "b.cs"


def test_git_log_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 2)
    lines = ["h1\0Ann\x002024-01-02T03:04:05Z\0fix", "1\t2\ta.cs", "-\t-\tb.png", "", "3\t0\tsrc/{old => new}/c.cs", "h2\0Bo\x002024-01-03T00:00:00Z\0y", "0\t1\tx => y.cs"]
    commits, touches = L.parse(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string"))
    assert sorted((r["commit_id"], r["author"], r["message"]) for r in commits.collect()) == [("h1", "Ann", "fix"), ("h2", "Bo", "y")]
    assert sorted((r["commit_id"], r["path"], r["added"], r["removed"]) for r in touches.collect()) == [("h1", "a.cs", 1, 2), ("h1", "b.png", 0, 0), ("h1", "src/new/c.cs", 3, 0), ("h2", "y.cs", 0, 1)]


def test_catalog(spark):
    t = spark.createDataFrame([("s", "t", "BASE TABLE"), ("s", "v", "VIEW")], "table_schema string, table_name string, table_type string")
    c = spark.createDataFrame([("s", "t", "b", "int", "NO", 2), ("s", "t", "a", "int", "NO", 1)], "table_schema string, table_name string, column_name string, data_type string, is_nullable string, ordinal_position int")
    r = spark.createDataFrame([("s", "p", "PROCEDURE")], "routine_schema string, routine_name string, routine_type string")
    k = spark.createDataFrame([("s", "t", "b", "s", "v", "id"), ("s", "t", "a", None, None, None)], "table_schema string, table_name string, column_name string, referenced_table_schema string, referenced_table_name string, referenced_column_name string")
    nodes, edges = C.nodes(t, c, r), C.edges(c, k)
    assert nodes.count() == 5 and edges.count() == 3
    assert {r["table"]: (r["label"], r["columns"], r["foreign_keys"]) for r in C.listing(nodes, edges).collect()} == {"s.t": ("Table", "a,b", "s.v.id"), "s.v": ("View", None, None)}
    assert [r["name"] for r in C.missing(spark.createDataFrame([("IX_a",), ("ix_b",), (None,)], "name string"), spark.createDataFrame([("ix_A",)], "name string")).collect()] == ["ix_b"]


def test_extractors(spark):
    files = [
        ("p", "m/a.py", "import os\nclass A(B):\n    def f(self):\n        g(1)\n"), ("p", "b.py", "def ("), ("p", "q.sql", "CREATE TABLE x.t (a INT); -- FROM nope\nINSERT INTO t SELECT 'FROM z' FROM [s].[u];"), ("p", "n.txt", "x"), ("p", "e.py", None),
        ("p", "i.tf", 'resource "aws_s3" "b" {\n  name = var.n\n}\n'), ("p", "c.cs", "namespace N.M;\npublic class C : Base, IThing {\n  [HttpGet(\"x/{id}\")]\n  public int Do(int a) {\n bus.Publish(new Ev()); } }"),
    ]
    rows = X.extract(spark.createDataFrame(files, "project string, path string, content string")).collect()
    have = {(r["kind"], r["type"], r["qualified_name"], r["target"] or r["label"]) for r in rows}
    assert {("node", None, "m.a.A", "Class"), ("edge", "INHERITS", "m.a.A", "B"), ("edge", "CALLS", "m.a.A.f", "g"), ("edge", "IMPORTS", "m.a", "os"), ("node", None, "x.t", "Table"), ("edge", "WRITES", "q.sql", "t"), ("edge", "READS", "q.sql", "s.u")} <= have
    assert {("edge", "REFERENCES", "aws_s3.b", "var.n"), ("node", None, "N.M.C", "Class"), ("edge", "IMPLEMENTS", "N.M.C", "IThing"), ("node", None, "GET:x/{id}", "Route"), ("edge", "PUBLISHES", "N.M.C", "Ev"), ("edge", "DEFINES_METHOD", "N.M.C", "N.M.C.Do")} <= have
    assert [(r["path"], r["name"]) for r in rows if r["kind"] == "error"] == [("b.py", "SyntaxError")] and not any(r["target"] in ("nope", "z") for r in rows)


def test_pattern_extractors():
    get = lambda ext, text: {(k, label or type, name or target) for k, _, name, label, type, target, _ in X.REGISTRY[ext]("f", text)}
    assert {("node", "Function", "Do"), ("node", "Class", "T"), ("edge", "IMPORTS", "fmt")} <= get("go", 'import (\n\t"fmt"\n)\ntype T struct {}\nfunc (t *T) Do() {}\n// func No() {}\n')
    assert {("node", "Class", "A"), ("node", "Method", "run"), ("edge", "IMPORTS", "x.Y")} <= get("java", "import x.Y;\npublic class A {\n  public static void run(int a) { }\n}")
    assert {("node", "Interface", "I"), ("node", "Function", "f"), ("edge", "IMPORTS", "./z")} <= get("ts", "import { a } from './z';\nexport interface I { }\nfunction f() { }\nclass C { go(): void { if (a) { } } }") and ("node", "Method", "if") not in get("ts", "class C {\n  go() {\n    if (a) {\n } } }")
    assert {("node", "Class", "S"), ("node", "Function", "f")} <= get("rs", "pub struct S;\npub fn f() { }") and ("edge", "IMPORTS", "a.h") in get("cpp", '#include "a.h"\nint main(void) {\n}')
    assert {("node", "AnsibleTask", "Install it"), ("edge", "NOTIFIES", "restart"), ("edge", "TARGETS", "web")} <= get("yml", "- hosts: web\n  tasks:\n  - name: Install it\n    notify: restart\n")
    assert get("rb", "") == set()


def test_text_helpers():
    assert X.diff_spans("--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n@@ -9,2 +3 @@\n@@ -20 +30,0 @@\n+++ /dev/null\n@@ -1 +0,0 @@\n") == [("x", 1, 3), ("x", 30, 30)]
    assert X.first_json('<think>{"no":1}</think> so: ```json\n{"a": "}", "b": [1]}\n``` end') == '{"a": "}", "b": [1]}' and X.first_json("none {") is None
    assert X.complexity("") == (0, 0.0, 0, 0, 0)
    assert X.complexity("class A {\n  public void f() {\n    if (x) {\n      y();\n    }\n  }\n}")[:3] == (3, 2 / 7, 1)
    assert X.complexity("def f():\n  if a:\n    b", braces=False)[0] == 2


def test_logs_pages_targets(spark):
    d = lambda n: datetime(2024, 1, n)
    log = spark.createDataFrame([(1, d(1), "Alpha", None), (2, d(2), "x", "ALPHA!"), (3, d(3), "alpha", None)], "id long, logged_at timestamp, message string, exception string")
    assert [r["id"] for r in G.search_log(log, d(1), d(2), "alpha").collect()] == [2, 1]
    pages = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 5, "x"), (5, 4, "y")], "id long, parent_id long, slug string")
    assert {r["id"]: (r["slug_path"], r["depth"]) for r in G.page_paths(pages).collect()} == {1: ("a", 0), 2: ("a/b", 1), 3: ("a/b/c", 2)}
    deep = spark.createDataFrame([(k, k - 1 if k else None, "s") for k in range(36)] + [(90, 91, "x"), (91, 90, "y")], "id long, parent_id long, slug string")
    assert {r["id"]: r["depth"] for r in G.page_paths(deep).collect()} == {k: k for k in range(36)}
    s = spark.createDataFrame([("p", 5.0, "r1"), ("p", 9.0, "r2"), ("p", 1.0, "r3"), ("p", 7.0, "r4"), ("q", 3.0, "z")], "path string, score double, reason string")
    assert [tuple(r) for r in G.inspection_targets(s, 1).collect()] == [("p", 22.0, "r2; r4; r1")]
    pr = spark.createDataFrame([("a", "net6.0"), ("a", "NET8.0"), ("b", "net6.0"), ("c", "foo"), ("d", "net8.0")], "project string, framework string")
    lc = spark.createDataFrame([("net6.0", date(2024, 11, 12)), ("net8.0", date(2026, 11, 10))], "framework string, end_of_life date")
    assert {r["project"]: r["status"] for r in G.support_status(pr, lc, date(2025, 1, 1)).collect()} == {"a": "mixed", "b": "out_of_support", "c": "unknown", "d": "supported"}
    assert spark.range(1).select(G.penalised(F.lit(3.0), F.lit("out_of_support"))).first()[0] == 1.0


def test_memory_graph(spark):
    t = datetime(2024, 1, 1)
    claims = spark.createDataFrame([(1, 10, 11, "Active", t), (2, 12, None, "active", t), (3, 11, 13, "conflicted", t)], "claim_id long, subject_id long, object_id long, status string, recorded_at timestamp")
    ents = spark.createDataFrame([(i,) for i in (10, 11, 12, 13, 14, 15)], "id long")
    edges = spark.createDataFrame([(14, 10, "knows")], "source_id long, target_id long, type string")
    assert [r["id"] for r in MG.orphan_entities(ents, claims, edges).collect()] == [15]
    ids, kept = MG.subgraph(ents.where("id = 11"), claims, 10, 10)
    assert {r["id"]: r["score"] for r in ids.collect()} == {11: 100, 10: 50, 13: 50} and kept.count() == 2
    assert {r["what"]: r["n"] for r in MG.counts(ents, claims, edges).collect()} == {"claims active": 2, "claims conflicted": 1, "entities": 6, "edges": 1, "orphan entities": 1}
    assert sorted(map(tuple, MG.relations(edges, ents.where("id = 10")).collect())) == [(10, "in", 14, "knows")]
    assert MG.induced(ents.where("id > 11"), edges).count() == 0 and MG.bundle(claims, 11).count() == 2


def test_cron():
    d = datetime
    assert G.next_run("*/15 * * * *", d(2024, 1, 1, 0, 14, 30)) == d(2024, 1, 1, 0, 15)
    assert G.next_run("0 3 * * 1", d(2024, 1, 1, 3, 0)) == d(2024, 1, 8, 3, 0)
    assert G.next_run("30 2 29 2 *", d(2024, 3, 1)) == d(2028, 2, 29, 2, 30)
    assert G.next_run("0 0 13 * 5", d(2024, 1, 1)) == d(2024, 1, 5)
    assert G.next_run("5-10/5,40 1 1 1 7", d(2024, 1, 1, 1, 6)) == d(2024, 1, 1, 1, 10)
    for bad in ("* * * *", "61 * * * *", "0 0 31 2 *", "a * * * *"):
        with pytest.raises(ValueError):
            G.next_run(bad, d(2024, 1, 1))


def test_memory_seeds_and_signals(spark):
    t = datetime(2024, 1, 1)
    claims = spark.createDataFrame([(1, 10, 11, "active", t), (2, 12, None, "active", t)], "claim_id long, subject_id long, object_id long, status string, recorded_at timestamp")
    ents = lambda kind: spark.createDataFrame([(99, 60.0, kind)], "id long, score double, kind string")
    cs = spark.createDataFrame([(1, "exact"), (2, "vector")], "claim_id long, kind string")
    assert {r["id"]: r["score"] for r in MG.anchored_seeds(ents("vector"), cs, claims, 9).collect()} == {10: 95.0, 11: 95.0, 12: 70.0}
    assert [r["id"] for r in MG.anchored_seeds(ents("lexical"), cs, claims, 9).collect()] == [99]
    seeds = spark.createDataFrame([(1, "c_1", "wallet is late", None, "is", t, 100.0, "exact"), (2, "my-wallet", "x", None, "is", t, 100.0, "exact"), (3, "c", "nothing", None, None, t, 100.0, "exact"), (4, "c", None, None, None, t, 41.0, "vector"), (5, "c_5", "my old wallet", None, "is", t, 100.0, "exact")], "claim_id long, external_id string, normalized_text string, value_text string, predicate string, recorded_at timestamp, score double, kind string")
    assert {r["claim_id"]: (r["score"], r["kind"]) for r in MG.sanitised(seeds, "My wallet", 9).collect()} == {2: (100.0, "exact"), 5: (90.0, "lexical"), 4: (41.0, "vector")}
    got = [(r["kind"], r["id"]) for r in MG.frontier(spark.createDataFrame([(10,)], "id long"), claims, 5).collect()]
    assert got == [("claim", "1"), ("entity", "11")]
    diag = spark.createDataFrame([(1, 0, 0, 2)], "stale_queued long, stale_processing long, retrying long, failed long")
    assert [r["signal"] for r in MG.health_signals(diag, 1).collect()] == ["stale_queued_writes", "failed_writes_present", "orphaned_claim_graph_rows"]
