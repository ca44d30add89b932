import random
import time
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strataweave.operators import cochange as C
from strataweave.operators import history as H
from strataweave.plans import sieve as S
from strataweave.queries import history as Q
from strataweave.queries import resolving as R

AS_OF = datetime(2024, 6, 30)
ST = "commit_id long, path string, author_date timestamp"


def shuffled(spark, run):
    """What `run` gives, and the rows that its stages write for others."""
    sc = spark.sparkContext
    sc.setJobGroup(name := f"t{random.random()}", name)
    got = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(name) for s in sc.statusTracker().getJobInfo(j).stageIds}
    return got, sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def busy(spark, paths=2000):
    """Two days on which all paths change, one of them in one commit."""
    return spark.range(2 * paths).select((F.col("id") % paths + 1).alias("n"), F.col("id") < paths).toDF("n", "first").select(F.when(F.col("first"), 0).otherwise(F.col("n")).alias("commit_id"), F.concat(F.lit("p"), F.col("n").cast("string"), F.lit(".cs")).alias("path"), F.when(F.col("first"), F.lit(datetime(2024, 6, 1))).otherwise(F.lit(datetime(2024, 6, 2))).alias("author_date"))


def test_pairs_are_not_shuffled(spark):
    n, rows = shuffled(spark, lambda: H.cochange_pairs(busy(spark), AS_OF).where("days = 2").count())
    assert n == 2000 * 1999 // 2 and rows < 100_000


def test_coupling_makes_no_pairs(spark):
    got, rows = shuffled(spark, lambda: H.coupling(busy(spark), AS_OF).groupBy("strength", "partners").count().collect())
    assert [tuple(r) for r in got] == [(1.0, 1999, 2000)] and rows < 100_000


def random_days(seed):
    rnd = random.Random(seed)
    days = {f"{rnd.choice('aZé𝄞_')}{i}.cs": rnd.sample(range(40), rnd.choice([1, 1, 1, 2, 2, 3, 5, 12, 40])) for i in range(150)}
    return days | {"alone.cs": [90], "twin1.cs": [70, 71], "twin2.cs": [70, 71]}


@pytest.mark.parametrize("cap", [None, 7])
def test_pairs_and_coupling_equal_all_pairs(spark, monkeypatch, cap):
    monkeypatch.setattr(C, "LEAST", 20)
    monkeypatch.setattr(C, "ASKED", 60)
    monkeypatch.setattr(C, "BATCH", 50)
    days = random_days(4)
    st = spark.createDataFrame([(k, p, datetime(2024, 3, 1, k % 24) + timedelta(days=d)) for p, ds in days.items() for d in ds for k in (d, d + 100)], ST)
    at = defaultdict(list)
    for p in sorted(days, key=str.encode):
        for d in days[p]:
            at[d].append(p)
    want = Counter(pair for ps in at.values() for pair in combinations(ps[:cap], 2))
    assert {(r["a"], r["b"]): r["days"] for r in H.cochange_pairs(st, AS_OF, cap=cap).collect()} == want
    met = defaultdict(list)
    for (a, b), n in want.items():
        met[a].append(n)
        met[b].append(n)
    coupled = H.coupling(st, AS_OF, cap=cap).collect()
    assert {r["path"]: (r["strength"], r["partners"]) for r in coupled} == {p: (round(min(max(ns) / len(days[p]), 1), 6), len(ns)) for p, ns in met.items()} and len(coupled) == len(met)
    assert H.cochange_pairs(st.limit(0), AS_OF).count() == H.coupling(st.limit(0), AS_OF).count() == 0


@pytest.mark.parametrize("name", ["file_health", "health_summary", "hotspots", "fleet_health", "file_concern"])
def test_health_makes_no_pairs(spark, monkeypatch, name):
    st = busy(spark).withColumn("path", F.concat(F.lit("src/b/"), F.col("path")))
    commits = st.select("commit_id", F.lit("Ann").alias("author"), "author_date", F.lit("x").alias("message")).distinct()
    touches = st.select("commit_id", "path", F.lit(1).cast("long").alias("added"), F.lit(0).cast("long").alias("removed"), F.lit(1).alias("seq"))
    monkeypatch.setattr(Q, "AS_OF", AS_OF)
    monkeypatch.setattr(Q, "V", lambda s, d, view, **given: {"h_commits": commits, "h_touches": touches}[view])
    monkeypatch.setattr(Q, "table", lambda s, d, name: spark.createDataFrame([], "l_orderkey long"), raising=False)
    got, rows = shuffled(spark, lambda: (Q if name != "fleet_health" else R).queries()[name](spark, "").collect())
    assert len(got) == {"health_summary": 1, "fleet_health": 1, "hotspots": 25}.get(name, 2000) and rows < 200_000
    if name == "file_health":
        assert {(r["changes"], r["partners"], r["truck_factor"]) for r in got} == {(2, 1999, 1)}


@pytest.fixture(scope="module")
def rare(spark, tmp_path_factory):
    """A folder of 40,000 lines; a tenth of their orders lie in the last two years, a fiftieth in the last half."""
    d = str(tmp_path_factory.mktemp("rare"))
    age = F.when(F.col("id") % 50 == 0, 100).when(F.col("id") % 10 == 0, 500).otherwise(1500)
    spark.range(4000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 97).alias("o_custkey"), F.date_sub(F.lit(Q.AS_OF), age + F.col("id").cast("int") % 13).cast("timestamp").alias("o_orderdate"), F.lit("2-HIGH").alias("o_orderpriority")).write.parquet(f"{d}/orders.parquet")
    spark.range(500).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand")).write.parquet(f"{d}/part.parquet")
    spark.range(40000).select((F.col("id") % 4000).alias("l_orderkey"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("l_partkey"), F.lit(4.0).alias("l_quantity"), F.lit(0.1).alias("l_discount"), F.floor(F.col("id") / 4000).cast("int").alias("l_linenumber")).write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize("name", ["file_health", "health_summary", "hotspots", "coupling", "fleet_health", "file_concern"])
def test_lines_outside_the_window_are_not_shuffled(spark, rare, name):
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got, rows = shuffled(spark, lambda: (Q if name != "fleet_health" else R).queries()[name](spark, rare).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)
    assert got and rows < 30_000


def left(spark, run):
    """What `run` gives, the bytes and the most rows that one of its stages writes for others, and the bytes of its shuffles on disk after it."""
    sc = spark.sparkContext
    folders = [Path(f.getPath()) for f in sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: [(int(p.name.split("_")[1]), p.stat().st_size) for d in folders for p in d.rglob("shuffle_*.data") if p.exists()]
    old = max(files(), default=(-1, 0))[0]
    sc.setJobGroup(name := f"t{random.random()}", name)
    got = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    time.sleep(1)  # files are deleted in the background
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(name) for s in sc.statusTracker().getJobInfo(j).stageIds}
    wrote = [sc._jsc.sc().statusStore().lastStageAttempt(s) for s in stages if sc.statusTracker().getStageInfo(s)]
    return got, sum(w.shuffleWriteBytes() for w in wrote), max(w.shuffleWriteRecords() for w in wrote), sum(n for k, n in files() if k > old)


@pytest.mark.parametrize("name", ["health_summary", "hotspots", "fleet_health", "file_concern"])
def test_shuffles_are_in_slices_and_deleted(spark, rare, monkeypatch, name):
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    query = (Q if name != "fleet_health" else R).queries()[name]
    try:
        whole = query(spark, rare).collect()
        monkeypatch.setattr(H, "LEAST", 100, raising=False)  # four slices of 400 commits, 4000 lines
        got, written, rows, kept = left(spark, lambda: query(spark, rare).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)
    assert sorted(map(str, got)) == sorted(map(str, whole)) and rows < 2000 and kept < 0.5 * written


def test_day_sets_leave_no_shuffle(spark, rare, monkeypatch):
    seen, real = [], H.cut
    monkeypatch.setattr(H, "cut", lambda df, label: seen.append(left(spark, lambda: real(df, label))) or seen[-1][0])
    assert Q.coupling(spark, rare).count()
    assert [(written > 10_000, kept) for _, written, _, kept in seen] == [(True, 0)]


def test_sieve_keeps_all_wanted(spark, monkeypatch):
    rows, keys = spark.range(-5000, 20000).toDF("k"), spark.range(-100, 20000, 100).union(spark.sql("SELECT CAST(NULL AS BIGINT)")).toDF("w")
    want = [k for k in range(-5000, 20000) if k % 100 == 0 and k >= -100]
    got = {r["k"] for r in S.sieve(rows, "k", keys).collect()}
    assert got >= set(want) and len(got) < len(want) + 20
    monkeypatch.setattr(S, "BITS", 256)  # too many keys for the map
    assert sorted(r["k"] for r in S.sieve(rows, "k", keys).collect()) == want
    assert S.sieve(rows, "k", keys.limit(0)).count() == 0


def test_figures_equal_those_one_by_one(spark):
    rnd = random.Random(5)
    commits = spark.createDataFrame([(i // 2 if i < 40 else i, rnd.choice(["Ann", "ann", "Bob", "Zoe", "Éva", None]), AS_OF - timedelta(days=rnd.choice([-3, 0, 20, 60, 120, 179, 180, 181, 300, 400, 729]), hours=rnd.choice([0, 5])), rnd.choice(["fix it", "more", None])) for i in range(300)], "commit_id long, author string, author_date timestamp, message string")
    touches = spark.createDataFrame([(rnd.randrange(300), f"src/{rnd.choice('aB')}{rnd.randrange(30)}.cs", rnd.choice([None, 0, 3, 8]), rnd.randrange(5), i) for i in range(1500)], "commit_id long, path string, added long, removed long, seq long")
    st = H.source_touches(commits, touches).cache()
    whole = {r["path"]: r.asDict() for r in H.figures(st, AS_OF).collect()}
    for part, least in ((H.churn(st, AS_OF), {"changes": 0}), (H.weighted_churn(st, AS_OF), dict.fromkeys(H.WEIGHED, 0.0)), (H.day_sets(st, AS_OF), {"n": 0, "days": []}), (H.knowledge(st, AS_OF), {})):
        want = {r["path"]: r.asDict() for r in part.collect()}
        assert want
        for path, row in whole.items():
            mine = {c: row[c] for c in part.columns}
            assert mine == pytest.approx(want[path] if path in want else dict.fromkeys(part.columns) | least | {"path": path}) if not {"days", "last_change", "top_authors"} & set(mine) else mine == (want[path] if path in want else dict.fromkeys(part.columns) | least | {"path": path})
        assert set(want) <= set(whole)
    st.unpersist()


@pytest.mark.parametrize("most", [0, 16, 10**9])
def test_few_days_are_counted_by_subsets(spark, monkeypatch, most):
    monkeypatch.setattr(C, "LEAST", 20)
    monkeypatch.setattr(C, "ASKED", 60)
    monkeypatch.setattr(C, "SUBSETS", most, raising=False)
    monkeypatch.setattr(C, "SLICE", 500, raising=False)
    rnd = random.Random(6)
    days = {f"p{i}.cs": sorted(rnd.sample(range(-30, 150), min(180, rnd.choice([1, 1, 2, 2, 3, 3, 4, 5, 8, 9, 30])))) for i in range(400)}
    days |= {"alone.cs": [400], "twin1.cs": [500, 501], "twin2.cs": [500, 501], "never.cs": []}
    sets = spark.createDataFrame([(p, len(ds), ds) for p, ds in days.items()], "path string, n int, days array<int>").cache()
    got = {r["path"]: (r["partners"], r["most"]) for r in C.partners(sets).collect()}
    met = {p: [m for q, es in days.items() if q != p and (m := len(set(ds) & set(es)))] for p, ds in days.items()}
    assert got == {p: (len(ms), max(ms)) for p, ms in met.items() if ms}
    assert C.partners(sets.limit(0)).count() == 0
    sets.unpersist()


def test_rows_of_few_days_are_not_copied_for_blocks(spark):
    rnd = random.Random(7)
    sets = H.cut(spark.createDataFrame([(f"p{i}", 2, sorted(rnd.sample(range(180), 2))) for i in range(20_000)], "path string, n int, days array<int>"), "sets")
    got, rows = shuffled(spark, lambda: C.partners(sets).count())
    assert got == 20_000 and rows < 200_000


def test_pairs_are_written_in_few_bytes(spark, tmp_path):
    """Names of more than parquet's dictionary takes at once: 3000 of 400 bytes."""
    st = busy(spark, 3000).withColumn("path", F.concat(F.lit("d/" * 196), F.col("path")))
    H.cochange_pairs(st, AS_OF).write.parquet(str(tmp_path / "pairs"))
    rows = spark.read.parquet(str(tmp_path / "pairs"))
    assert rows.count() == rows.distinct().count() == 3000 * 2999 // 2
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 3 * rows.count()


@pytest.mark.parametrize(("names", "blocks", "chunk"), [(200, 100, 2), (200, 3, 250), (10**6, 100, 3)])
def test_pairs_of_tiles_equal_all_pairs(spark, monkeypatch, names, blocks, chunk):
    for k, v in {"NAMES": names, "BLOCKS": blocks, "CHUNK": chunk, "BATCH": 20}.items():
        monkeypatch.setattr(C, k, v, raising=False)
    days = random_days(8) | {f"Brand{i}/equal.cs": [3, 9] for i in range(11)} | {"never.cs": []}
    sets = H.cut(spark.createDataFrame([(p, len(ds), sorted(ds)) for p, ds in days.items()], "path string, n int, days array<int>"), "sets")
    got = [((r["a"], r["b"]), r["days"]) for r in C.pairs(sets).collect()]
    want = {(a, b): n for a, b in combinations(sorted(days, key=str.encode), 2) if (n := len(set(days[a]) & set(days[b])))}
    assert dict(got) == want and len(got) == len(want)
