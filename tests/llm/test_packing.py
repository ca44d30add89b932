import random
from collections import Counter, defaultdict

from strataweave.llm import packing as P

DOCS = "doc_id long, text string, tokens string, piece string"
SIZES = "container_kind string, capacity_tokens int, cap int"


def best_fit(lengths, capacity):
    rooms = []
    for s in sorted(lengths, reverse=True):
        i = min((i for i, r in enumerate(rooms) if r >= s), key=lambda i: rooms[i], default=None)
        if i is None:
            rooms.append(capacity - s)
        else:
            rooms[i] -= s
    return len(rooms)


def test_plan_equals_best_fit_one_by_one():
    rnd = random.Random(2)
    for capacity, n in ((10, 50), (64, 300), (512, 900)):
        for _ in range(20):
            lengths = [min(capacity, 1 + int(rnd.expovariate(4 / capacity))) for _ in range(n)]
            groups = P.plan(dict(Counter(lengths)), capacity)
            assert all(g.room >= 0 and sum(s * t for s, t in g.parts) + g.room == capacity for g in groups)
            placed = Counter()
            for g in groups:
                for s, t in g.parts:
                    placed[s] += t * g.count
            assert placed == Counter(lengths)
            assert sum(g.count for g in groups) <= best_fit(lengths, capacity) + 1


def test_every_token_has_one_place(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 7)
    rnd = random.Random(4)
    docs = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.choice([1, 3, 3, 3, 20, 90]))), "", "") for i in range(80)]
    docs += [(100, None, "", ""), (101, "", "", ""), (102, "x " * 3000, "", ""), (5, docs[5][1], "", "")]
    sizes = spark.createDataFrame([("s", 16, 0), ("s", 16, 0), ("m", 50, 0), ("none", None, 0), ("zero", 0, 0)], SIZES)
    df = spark.createDataFrame(docs, DOCS)
    rows = P.pack(df, sizes).collect()
    enc = P.token_count.__globals__["encoding"](P.VOCABULARY)
    total = sum(len(enc.encode_ordinary(t)) if t else 0 for _, t, _, _ in docs)
    for kind, cap in (("s", 16), ("m", 50)):
        own = [r for r in rows if r["container_kind"] == kind]
        assert sum(r["n_tokens"] for r in own) == total
        assert {r["doc_id"] for r in own if r["container_id"] is None} == {100, 101}
        inside = defaultdict(list)
        for r in own:
            if r["container_id"] is not None:
                inside[r["container_id"]].append((r["offset"], r["offset"] + r["n_tokens"]))
        assert set(inside) == set(range(len(inside)))
        for spans in inside.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= cap and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert all(r["n_tokens"] == cap or r["piece"] == 0 or r["n_tokens"] < cap for r in own)
        assert len(inside) <= -(-total // cap) * 1.1 + 2
    assert {r["container_kind"] for r in rows} == {"s", "m"}


def test_empty(spark):
    sizes = spark.createDataFrame([("s", 16, 0)], SIZES)
    docs = spark.createDataFrame([], DOCS)
    assert P.pack(docs, sizes).count() == 0
    assert P.packing_report(P.pack(docs, sizes), sizes).count() == 0
    assert P.pack(spark.createDataFrame([(1, "a", "", "")], DOCS), sizes.limit(0)).count() == 0
