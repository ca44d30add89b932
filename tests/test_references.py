from datetime import datetime

from strataweave.operators import references as R

T = lambda n: datetime(2024, 1, n) if n else None
EDGES = "pending_edge_id long, project string, source_qn string, target_qn string, extracted_at timestamp, received_at timestamp, reason string, k1 string"
IMPACTS = "impact_id long, target_project string, computed_at timestamp, at string"
NODES = "id long, project string, qualified_name string, created_at timestamp, deleted_at timestamp, living string"
REPOS = "name string, created_at timestamp, deleted_at timestamp, t_from string"


def run(spark, edges=(), impacts=(), nodes=(), repos=()):
    f = R.orphan_references(
        spark.createDataFrame([(i, p, s, t, T(a), T(b), None, None) for i, p, s, t, a, b in edges], EDGES), spark.createDataFrame([(i, p, T(a), None) for i, p, a in impacts], IMPACTS),
        spark.createDataFrame([(i, p, q, T(a), T(b), None) for i, p, q, a, b in nodes], NODES), spark.createDataFrame([(n, T(a), T(b), None) for n, a, b in repos], REPOS),
    )
    return f, sorted((r["ref_id"], r["ref_field"], r["reason"]) for r in f.collect())


def test_reasons(spark):
    nodes = [(1, "a", "X", 5, 10), (2, "A ", "X", 15, None), (1, "a", "X", 5, 10), (3, "a", "Y", 8, 6), (4, "a", "N", None, None), (5, None, "X", 1, None)]
    edges = [
        (1, " A", "X", "x", 7, 8), (2, "a", "X", None, 10, 11), (3, "a", "X", "  ", 2, 3), (4, "a", "X", " ", 15, 16), (5, "b", "X", "", 7, 8),
        (6, "a", "Y", "N", 7, 8), (7, "a", "X", "X", None, 3), (8, None, "X", None, 7, 8), (1, " A", "X", "x", 7, 20),
    ]
    _, got = run(spark, edges, nodes=nodes)
    assert got == [(1, "target_qn", "missing"), (2, "source_qn", "deleted"), (3, "source_qn", "late"), (5, "source_qn", "missing"), (6, "source_qn", "deleted"), (6, "target_qn", "late"), (7, "source_qn", "late"), (7, "target_qn", "late"), (8, "source_qn", "missing")]


def test_repositories_and_report(spark):
    found, got = run(spark, impacts=[(1, "Core ", 5), (1, "Core ", 5), (2, "gone", 9), (3, None, 5), (4, " ", 5), (5, "core", 1)], repos=[("core", 2, None), ("core", 2, None), ("Gone", 1, 4)])
    assert got == [(2, "target_project", "deleted"), (5, "target_project", "late")]
    assert sorted(map(tuple, R.orphan_report(found).collect())) == [("cross_repo_impacts", "target_project", "2024-01", "deleted", 1), ("cross_repo_impacts", "target_project", "2024-01", "late", 1)]


def test_empty_tables(spark):
    assert run(spark)[1] == []
    assert run(spark, edges=[(1, "a", "X", None, 2, 3)])[1] == [(1, "source_qn", "missing")]


def test_state_from_deltas_equals_the_full_run(spark):
    """Period by period, with keys that lose their last record or reference and come back."""
    import random

    rnd = random.Random(8)
    refs = spark.createDataFrame([(k, -k, rnd.choice([None, *range(1, 40)])) for k in [rnd.randrange(12) for _ in range(90)]], "k1 long, k2 long, at long")
    lives = spark.createDataFrame([(k, -k, b, rnd.choice([None, b - 3, b + 1, b + 9])) for k in range(9) for b in rnd.sample(range(5, 38), 3)] + [(10, -10, None, 7)], "k1 long, k2 long, born long, gone long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for end in (4, 17, 60):
        state, last = None, R._START
        for until in [t for t in (3, 4, 11, 17, 25, 60) if t <= end]:
            state, last = R.advance(state, R.key_deltas(refs, lives, last, until)), until
        full = R.advance(None, R.key_deltas(refs, lives, until=end))
        assert rows(state) == rows(full)
        at = refs.collect()
        alive = lambda k: sum(r["born"] is not None and r["born"] <= end and (r["gone"] is None or r["gone"] > end) for r in lives.collect() if r["k1"] == k and not (r["gone"] is not None and r["born"] is not None and r["gone"] <= r["born"]))
        want = {k for k in range(12) if any(r["k1"] == k and (r["at"] is None or r["at"] <= end) for r in at) and not alive(k)}
        assert {r["k1"] for r in R.current_orphans(state).collect()} == want
    assert rows(R.advance(None, R.key_deltas(refs.limit(0), lives.limit(0)))) == []
