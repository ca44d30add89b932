import json
import math
from datetime import datetime

import numpy as np

from strataweave.llm import neighbours as N

SCHEMA = "id long, embedding_json string, updated_at timestamp, vec string, cls string"


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8 + 1, 64))
    x = centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, 64)) * rng.choice([0.1, 0.3, 3.0], size=(n, 1))
    return x * rng.uniform(0.1, 9, size=(n, 1))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, datetime(2024, 1, d), "", "") for i, t, d in rows], SCHEMA)


def brute(vecs, k, least):
    ids = sorted(vecs)
    x = np.array([vecs[i] for i in ids])
    s = np.round(x @ x.T, 10)
    out = {}
    for r, i in enumerate(ids):
        order = sorted((c for c in range(len(ids)) if c != r and s[r, c] >= least), key=lambda c: (-s[r, c], ids[c]))[:k]
        out[i] = [ids[c] for c in order]
    return out


def test_exact_against_brute_force_with_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD", 60)
    monkeypatch.setattr(N, "LEAF", 8)
    x = clustered(200)
    rows = [(i * 7 % 1000, json.dumps(list(v)), 1) for i, v in enumerate(x)]
    rows += [(5000 + i, json.dumps(list(x[3])), 1) for i in range(30)] + [(6000 + i, json.dumps(list(x[4] * 2)), 1) for i in range(4)]
    vecs = {i: N.parse_vector(t) for i, t, _ in rows}
    want = brute(vecs, 10, 0.85)
    got = {}
    for r in N.neighbours(frame(spark, rows), factor=1.0).collect():
        got.setdefault(r["id_a"], {})[r["rank"]] = r["id_b"]
    assert {i: [b for _, b in sorted(v.items())] for i, v in got.items()} == {i: v for i, v in want.items() if v}
    pairs = {tuple(r) for r in N.similar_pairs(frame(spark, rows), factor=1.0).collect()}
    assert pairs == {(min(a, b), max(a, b)) for a, v in want.items() for b in v}
    asked = brute(vecs, 10, -1.0)
    some = {}
    for r in N.neighbours(frame(spark, rows), least=-1.0, factor=1.0, asked="id % 100 = 0").collect():
        some.setdefault(r["id_a"], {})[r["rank"]] = r["id_b"]
    assert {i: [b for _, b in sorted(v.items())] for i, v in some.items()} == {i: asked[i] for i in asked if i % 100 == 0}


def test_default_factor_keeps_recall():
    x = clustered(6000, 5)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    full, _ = N.search(x, x, 11, 0.85, 1.0, same=True)
    some, _ = N.search(x, x, 11, 0.85, N.FACTOR, same=True)
    a, b = (set(zip(*m.rows()[:2])) for m in (full, some))
    assert len(a & b) >= 0.99 * len(a) and len(a) > 1000


def test_unusable_vectors():
    ok = [0.0] * 63 + [2]
    assert N.parse_vector(json.dumps(ok))[63] == 1.0
    for bad in (None, "", "[]", "x", "{}", "3", json.dumps([0.0] * 64), json.dumps(ok[:63]), json.dumps([*ok, 1]), json.dumps([None, *ok[1:]]), json.dumps([True, *ok[1:]]), json.dumps(["1", *ok[1:]]), "[NaN," + json.dumps(ok[1:])[1:], "[1e999," + json.dumps(ok[1:])[1:], "[" * 100_000):
        assert N.parse_vector(bad) is None
    assert math.isclose(float(np.linalg.norm(N.parse_vector(json.dumps([1e-300] * 64)))), 1.0) and N.parse_vector(json.dumps([1e300] * 64)) is not None


def test_versions_and_empty(spark):
    e = lambda k: json.dumps([float(j == k) for j in range(64)])
    rows = [(1, e(0), 1), (2, e(1), 1), (2, e(0), 2), (3, e(0), 1), (3, None, 2), (4, e(0), 1), (4, e(0), 1), (None, e(0), 1)]
    assert sorted(map(tuple, N.similar_pairs(frame(spark, rows)).collect())) == [(1, 2), (1, 4), (2, 4)]
    assert N.similar_pairs(frame(spark, [])).count() == 0
    assert N.neighbours(frame(spark, rows), asked="id > 99").count() == 0
