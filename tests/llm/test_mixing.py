from strataweave.llm import mixing as M

DOCS = "doc_id long, source string, text string, key string, budget string"
TARGETS = "source string, target_share double, max_repeats int, b int"


def run(spark, docs, targets, total=None):
    mixed, shares = M.mix(spark.createDataFrame([(i, s, t, "", "") for i, s, t in docs], DOCS), spark.createDataFrame([(*t, 0) for t in targets], TARGETS), total)
    return mixed.collect(), {r["source"]: r for r in shares.collect()}


def test_budgets():
    assert M.budgets({"a": (0.5, 1), "b": (0.5, 4)}, {"a": 1000, "b": 100}) == {"a": 400, "b": 400}
    assert M.budgets({"a": (1.0, 1), "b": (1.0, 4)}, {"a": 1000, "b": 100}, total=100) == {"a": 50, "b": 50}
    assert M.budgets({"a": (1.0, 1)}, {}) == {}


def test_shares_are_reached_and_repeats_capped(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 40)
    docs = [(i, "big", "word " * (i % 17 + 1)) for i in range(600)] + [(1000 + i, "small", "term " * (i % 5 + 1)) for i in range(40)] + [(5000, "other", "x"), (5001, None, "x"), (5002, "big", None), (5003, "big", "")]
    mixed, shares = run(spark, docs, [("big", 0.7, 1), ("small", 0.3, 3), ("small", 0.3, 3), ("none", None, 1)])
    for s in ("big", "small"):
        own = [r for r in mixed if r["source"] == s]
        got = sum(r["n_tokens"] * r["repeats"] for r in own)
        assert got == shares[s]["tokens"] and abs(got - shares[s]["budget"]) <= max(r["n_tokens"] for r in own)
        assert len({r["doc_id"] for r in own}) == len(own) and max(r["repeats"] for r in own) <= shares[s]["max_repeats"]
        assert abs(shares[s]["actual_share"] - shares[s]["target_share"]) < 0.02
    assert shares["small"]["tokens"] == 3 * shares["small"]["available"]
    assert {r["source"] for r in mixed} == {"big", "small"}
    again, _ = run(spark, docs, [("big", 0.7, 1), ("small", 0.3, 3)])
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixed))


def test_one_long_text_on_the_cut_costs_no_share(spark):
    """What no long text fits into goes to the later ones that fit."""
    docs = [(i, "a", "word " * (900 if i % 7 == 0 else 3)) for i in range(140)] + [(1000 + i, "b", "word " * 4) for i in range(500)]
    mixed, shares = run(spark, docs, [("a", 0.1, 1), ("b", 0.9, 1)])
    assert all(0 <= shares[s]["budget"] - shares[s]["tokens"] < 6 for s in ("a", "b")) and shares["a"]["budget"] < 400
    mixed, shares = run(spark, docs, [("a", 0.2, 1), ("b", 0.8, 1)])  # more than all short ones, less than a long one
    assert shares["a"]["items"] == 120 and sum(r["n_tokens"] * r["repeats"] for r in mixed) == shares["a"]["tokens"] + shares["b"]["tokens"]


def test_missing_source_and_empty(spark):
    _, shares = run(spark, [(1, "a", "one two three")], [("a", 0.5, None), ("b", 0.5, 2)])
    assert (shares["a"]["tokens"], shares["b"]["tokens"]) == (3, 0)
    mixed, shares = run(spark, [], [("a", 0.5, 1)])
    assert mixed == [] and shares["a"]["tokens"] == 0
    assert run(spark, [(1, "a", "x")], [])[0] == []
