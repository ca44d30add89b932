from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strataweave.operators import history as H
from strataweave.operators import reports as R
from strataweave.queries import history as Q

AS_OF = datetime(2024, 6, 30)


def test_health_summary_weights_the_sick(spark):
    m = spark.createDataFrame([("p", 10.0), ("p", 1.0), ("q", 5.0)], "k string, health double")
    assert {r["k"]: (r["health"], r["hotspots"], r["alerts"]) for r in H.health_summary(m, "k").collect()} == {"p": (1.8, 1, 1), "q": (5.0, 0, 0)}
    assert H.health_summary(m.limit(0)).first()["health"] == 5.0


def test_subscores_and_status(spark):
    one = spark.range(1)
    sub = H.subscores(F.lit(100), F.lit(60), F.lit(1.0), F.lit(100), F.lit(5))
    assert tuple(one.select(*sub.values()).first()) == (1.0, 1.0, 1.0, 9.0)
    assert one.select(H.health(H.subscores(F.lit(0), F.lit(0), F.lit(0.0), F.lit(0), F.lit(0)), F.lit(0), F.lit(0))).first()[0] == 9.4
    status = lambda *a: one.select(H.activity_status(*map(F.lit, a))).first()[0]
    assert [status(3, 3, 0, 10), status(2, 2, 4, 10), status(0, 2, 14, 10), status(0, 0, 6, 10), status(0, 0, 11, 10), status(0, 0, 15, 10)] == ["PossiblyAbandoned", "Dormant", "Revived", "Slowing", "Stable", "Active"]
    assert one.select(H.role(F.lit("a\\Tests\\b.cs")), H.role(F.lit("a/testing2/b.cs"))).first()[:] == ("test", "core")


def test_touches_shares_and_truck_factor(spark):
    c = spark.createDataFrame([(1, "Ann", datetime(2024, 6, 1), "fix it"), (2, "ann", datetime(2024, 6, 2), "x"), (3, "Bo", datetime(2020, 1, 1), "y")], "commit_id long, author string, author_date timestamp, message string")
    t = spark.createDataFrame([(1, "a.cs", 3, 0, 1), (1, "b.cs", 1, 0, 2), (1, "A.cs", 1, 0, 3), (1, "x.md", 9, 9, 4), (2, "a.cs", 0, 0, 1), (3, "a.cs", 5, 0, 1)], "commit_id long, path string, added long, removed long, seq int")
    st = H.source_touches(c, t)
    assert {(r["commit_id"], r["path"]): r["weight"] for r in st.collect()} == {(1, "b.cs"): 0.5, (1, "A.cs"): 0.5, (2, "a.cs"): 1.0, (3, "a.cs"): 1.0}
    assert {r["path"]: (r["changes"], r["authors"]) for r in H.churn(st, AS_OF).collect()} == {"A.cs": (1, 1), "a.cs": (1, 1), "b.cs": (1, 1)}
    assert {r["path"]: r["truck_factor"] for r in H.knowledge(st, AS_OF).collect()} == {"A.cs": 1, "a.cs": 1, "b.cs": 1}
    assert H.file_metrics(c.limit(0), t.limit(0), AS_OF).count() == 0


def test_every_path_of_a_busy_day_pairs_up(spark):
    c = spark.createDataFrame([(1, "Ann", datetime(2024, 6, 1), "x"), (2, "Ann", datetime(2024, 6, 2), "x")], "commit_id long, author string, author_date timestamp, message string")
    t = spark.createDataFrame([(1, f"p{i:02}.cs", 1, 0, i) for i in range(70)] + [(2, "p68.cs", 1, 0, 1), (2, "p69.cs", 1, 0, 2)], "commit_id long, path string, added long, removed long, seq int")
    st = H.source_touches(c, t)
    got = {(r["a"], r["b"]): r["days"] for r in H.cochange_pairs(st, AS_OF).collect()}
    assert len(got) == 70 * 69 // 2 and all(a < b for a, b in got) and {k for k, n in got.items() if n > 1} == {("p68.cs", "p69.cs")} and got["p68.cs", "p69.cs"] == 2
    assert {r["partners"] for r in H.file_metrics(c, t, AS_OF).collect()} == {69}
    assert H.cochange_pairs(st, AS_OF, cap=50).count() == 50 * 49 // 2 + 1  # and the pair of the other day


def test_vitality_of_a_whole_history(spark, monkeypatch):
    """Months of the trailing year, oldest first: dormant, revived; and a query that thins no commits."""
    month = lambda i: datetime(2023 + (i + 6) // 12, (i + 6) % 12 + 1, 1)
    look = lambda counts: H.vitality(spark.createDataFrame([(month(i), n) for i, n in enumerate(counts)], "month timestamp, commits long")).first()
    dormant, revived = look([4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 0, 0]), look([3, 0, 0, 0, 1, 0, 5, 5, 5, 5, 5, 5])
    assert (dormant["status"], dormant["max_inactive_streak"], dormant["silent_now"]) == ("Dormant", 2, 2)
    assert (revived["status"], revived["max_inactive_streak"], revived["dormant_months"]) == ("Revived", 3, 4)
    at = [Q.AS_OF.replace(year=2000 + (i + 8) // 12, month=(i + 8) % 12 + 1) for i in range(12)]
    c = spark.createDataFrame([(i + 1, "Ann", t, "x") for i, t in enumerate(at)], "commit_id long, author string, author_date timestamp, message string")
    t = spark.createDataFrame([(i + 1, "a.cs", 1, 0, 1) for i in range(12)], "commit_id long, path string, added long, removed long, seq int")
    monkeypatch.setattr(Q, "V", lambda s, d, name: {"h_commits": c, "h_touches": t}[name])
    got = Q.activity_status(spark, "").first()
    assert (got["last6"], got["prior6"], got["status"]) == (6, 6, "Stable") and Q.inactive_streak(spark, "").first()[:] == (0, 0)


def test_intervals():
    day = lambda n: datetime(2024, 1, 1) + (datetime(2024, 1, 2) - datetime(2024, 1, 1)) * n
    assert [R.interval(day(0), day(n)) for n in (45, 46, 180, 181)] == ["day", "week", "week", "month"]
    with pytest.raises(ValueError):
        R.interval(day(1), day(1))


def test_series_fills_the_spine_and_weeks_begin_on_monday(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 7, 23), "a"), (datetime(2024, 1, 22), "b")], "created_at timestamp, tool string")
    rows = R.series(df, datetime(2024, 1, 3), datetime(2024, 1, 22), "week", n=F.count("*")).orderBy("bucket").collect()
    assert [(r["bucket"].day, r["n"]) for r in rows] == [(1, 1), (8, 0), (15, 0)]
    assert R.series(df.limit(0), datetime(2024, 1, 1), datetime(2024, 1, 3), "day", n=F.count("*")).count() == 2


def test_breakdown_and_events(spark):
    df = spark.createDataFrame([("a", 1), (" ", 5), (None, 2), ("z", 0)], "k string, v long")
    assert [tuple(r) for r in R.breakdown(df, "k", F.sum("v"), 9).collect()] == [("(unknown)", 7), ("a", 1)]
    stored = spark.createDataFrame([("1",)], "event_id string")
    new = spark.createDataFrame([("1", 1), ("2", 1), ("2", 2), ("", 3), (None, 4)], "event_id string, v long")
    got = R.insert_new(stored, new).collect()
    assert len(got) == 3 and all(r["event_id"] for r in got)
