from pyspark.sql import Row

from strataweave.operators import impact as I
from strataweave.operators import memory as M
from strataweave.operators import schemas as SC
from strataweave.operators import store as S
from strataweave.operators import vectors as VS
from strataweave.streaming import usage as U


def test_page_totals():
    assert S.page_total(3, 2, 10) == 13 and S.page_total(10, 1, 10) == -1 and S.page_total(0, 1, 10) == 0


def test_open_observations(spark):
    o = spark.createDataFrame([(1, False, ["A"], "x"), (2, False, [], "says Claim_9 is off"), (3, True, ["a"], "x"), (4, False, None, None), (5, False, ["b"], "x")], "id int, resolved boolean, about array<string>, text string")
    assert sorted(r["id"] for r in S.unresolved(o, ["a", " ", "claim_9"]).collect()) == [1, 2]
    assert S.unresolved(o, ["", " "]).count() == 0


def test_secret_paths_and_pages(spark):
    f = spark.createDataFrame([("secret", "a"), ("secret", "a"), ("secret", None), ("attack_surface", "b")], "category string, path string")
    assert [r["path"] for r in S.secret_paths(f).collect()] == ["a"]
    p = spark.createDataFrame([(1, "Intro", None), (2, None, "the intro"), (3, "x", "y"), (4, None, None)], "id int, slug string, title string")
    assert sorted(r["id"] for r in S.search_pages(p, "INTRO").collect()) == [1, 2]


def test_file_impact_falls_back_to_the_file_itself(spark):
    n = spark.createDataFrame([(1, "p", "a.cs", "File"), (2, "p", "a.cs", "Class"), (3, "p", "b.cs", "File"), (4, "q", "a.cs", "Class")], "id long, project string, file_path string, label string")
    assert [r["id"] for r in I.of_file(n, "p", "a.cs").collect()] == [2] and [r["id"] for r in I.of_file(n, "p", "b.cs").collect()] == [3] and I.of_file(n, "p", "c.cs").count() == 0


def test_schemas_without_names_and_nodes(spark):
    r = spark.createDataFrame([("db:a", '{"serverName": "S", "databaseName": "D"}'), ("b", None), ("c", '{"serverName": " "}'), ("db:z", '{"serverName": "s", "databaseName": "d"}')], "name string, properties string")
    assert [x["name"] for x in SC.ordered(SC.schema_repositories(r)).collect()] == ["db:a", "db:z"]
    assert SC.schema_repositories(r, server="s", database="D").count() == 2 and SC.schema_repositories(r, search="Z").count() == 1
    n = spark.createDataFrame([("db:a", "Table"), ("db:a", "View"), ("db:a", "Class")], "project string, label string")
    got = SC.with_counts(SC.schema_repositories(r), n)
    assert {(x["name"], x["tables"], x["views"], x["procedures"]) for x in got.collect()} == {("db:a", 1, 1, 0), ("db:z", 0, 0, 0)}
    assert SC.totals(got.limit(0)).first()[:] == (0, 0, 0, 0)


def test_vectors_of_a_type(spark):
    kind = "entity_type string, entity_key string, embedding array<float>, model string, dimensions int"
    v = spark.createDataFrame([("A", "1", [1.0, 0.0], "m", 2), ("A", "12", [0.0, 1.0], "m", 2), ("B", "x", [1.0, 0.1], "m", 2), ("A", "3", [], "m", 0), ("A", "4", None, "n", 2)], kind)
    assert [r["entity_key"] for r in VS.search(v, [1.0, 0.0], 5, 0.0, entity_type="A", model="m", dimensions=2).collect()] == ["1", "12"]
    assert sorted(r["entity_key"] for r in VS.delete(v, "A", prefix="1").collect()) == ["3", "4", "x"] and VS.delete(v, "A", key="1").count() == 4
    new = spark.createDataFrame([("A", "1", [0.0, 1.0], "n", 2), ("C", "9", [1.0, 1.0], "n", 2)], kind)
    assert {(r["entity_type"], r["entity_key"], r["model"]) for r in VS.upsert(v, new).collect()} >= {("A", "1", "n"), ("C", "9", "n"), ("A", "12", "m")} and VS.upsert(v, new).count() == 6
    nodes = spark.createDataFrame([(1, "p"), (12, "q")], "id long, project string")
    hits = VS.search(v, [1.0, 0.0], 5, -1.0)
    assert sorted(r["id"] for r in VS.hydrate(hits, nodes).collect()) == [1, 12] and [r["id"] for r in VS.hydrate(hits, nodes, "q").collect()] == [12]


def test_entities_merge_in_order(spark):
    kind = "external_id string, label string, type string, canonical_name string, aliases array<string>, summary string, source string"
    old = spark.createDataFrame([("a_b", "L", "T", None, [], " ", "s0")], kind)
    new = spark.createDataFrame([("A b", "L2", "T2", " N ", [" x ", "X", ""], "sum", None, 2), ("a_b", "L1", "T1", "first", ["y"], "one", "s1", 1), ("C", "L3", "T3", None, None, None, None, 3)], kind + ", n int")
    got = {r["external_id"]: r for r in M.resolve_entities(old, new, "batch").collect()}
    assert got["a_b"] == Row(external_id="a_b", label="L", type="T", canonical_name="first", aliases=["y"], summary="one", source="s1")
    assert got["c"] == Row(external_id="c", label="L3", type="T3", canonical_name=None, aliases=[], summary="", source="batch") and len(got) == 2


def test_batches_are_tried_again_then_put_aside():
    calls, aside, slept = [], [], []

    def step(batch):
        calls.append(batch)
        if batch == "never" or batch == "later" and len(calls) < 6:
            raise ValueError(batch)
        if batch == "bad":
            raise U.DoNotRetry(batch)

    run = U.retried(step, lambda b, e: aside.append((b, type(e))), limit=2, redeliver=(60.0,), sleep=slept.append)
    run("good"), run("bad")
    assert calls == ["good", "bad"] and aside == [("bad", U.DoNotRetry)] and slept == []
    run("later")
    assert len(calls) == 6 and slept == [0.5, 1.0, 60.0] and len(aside) == 1
    run("never")
    assert aside[-1] == ("never", ValueError) and slept[3:] == [0.5, 1.0, 60.0, 0.5, 1.0]


def test_one_worker(spark, tmp_path):
    spark.range(40, numPartitions=4).write.parquet(str(tmp_path / "in"))
    seen = []
    U.one_at_a_time(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda b: seen.append((b.rdd.getNumPartitions(), b.count())), str(tmp_path / "c")).awaitTermination()
    assert sum(n for _, n in seen) == 40 and all(p == 1 for p, _ in seen)
