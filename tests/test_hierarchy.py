import random

from strataweave.operators import hierarchy as H

SCHEMA = "id long, parent_node_id long, indexed_at timestamp, root_id string, depth string"


def frame(spark, links):
    from datetime import datetime

    return spark.createDataFrame([(i, p, datetime(2024, 1, 1), "x", None) for i, p in links], SCHEMA)


def brute(links):
    parent = {i: p for i, p in links}
    out = {}
    for v in parent:
        path, u = [v], v
        while parent[u] is not None and parent[u] in parent and parent[u] not in path:
            u = parent[u]
            path.append(u)
        ring = parent[u] is not None and parent[u] in parent
        out[v] = (-1, -1, None) if ring else (u, len(path) - 1, path[::-1])
    return out


def check(spark, links, monkeypatch=None):
    want = brute(links)
    rows = {r["id"]: r for r in H.hierarchy(frame(spark, links)).collect()}
    assert rows.keys() == want.keys()
    for v, (root, depth, path) in want.items():
        assert (rows[v]["root_id"], rows[v]["depth"], rows[v]["path"]) == (root, depth, path)
    for v, (root, depth, _) in want.items():
        if depth >= 0:
            below = {u for u, (r, _, p) in want.items() if p and v in p and u != v}
            assert rows[v]["n_descendants"] == len(below)
            assert below == {u for u in want if rows[u]["root_id"] == root and rows[u]["first"] is not None and rows[v]["first"] < rows[u]["first"] <= rows[v]["last"]}
        else:
            assert rows[v]["first"] is None and rows[v]["n_descendants"] is None


def test_random_forest_with_rings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 4)  # so that chains span several blocks
    rnd = random.Random(5)
    links = [(i, rnd.choice([None, 9999, *[rnd.randrange(max(0, i - 6), i) for _ in range(9)]]) if i else None) for i in range(120)]
    links += [(200, 202), (201, 200), (202, 201), (203, 202), (204, 203), (205, 205)]
    links += [(300 + i, 300) for i in range(1, 40)] + [(300, None)]
    check(spark, links)


def test_long_chain(spark):
    check(spark, [(i, i - 1 if i else None) for i in range(70)])


def test_empty(spark):
    out = H.hierarchy(frame(spark, []))
    assert out.count() == 0 and "path" in out.columns


def test_versions_nulls_and_repeats(spark):
    from datetime import datetime

    d = lambda n: datetime(2024, 1, n)
    df = spark.createDataFrame([(1, None, d(1), "", ""), (2, 1, d(1), "", ""), (2, None, d(2), "", ""), (2, None, d(2), "", ""), (None, 1, d(1), "", ""), (3, 2, None, "", ""), (4, 3, d(1), "", "")], SCHEMA)
    assert {r["id"]: (r["root_id"], r["depth"]) for r in H.hierarchy(df).collect()} == {1: (1, 0), 2: (2, 0), 3: (2, 1), 4: (2, 2)}


def test_descendants_of_a_stated_set(spark):
    labels = H.hierarchy(frame(spark, [(1, None), (2, 1), (3, 2), (4, 1), (9, 9)]))
    asked = spark.createDataFrame([(2,), (1,), (9,)], "id long")
    assert sorted(map(tuple, H.descendants(labels, asked).collect())) == [(1, 2), (1, 3), (1, 4), (2, 3)]
