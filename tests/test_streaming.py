from datetime import datetime, timedelta

from strataweave.streaming import usage as U

SCHEMA = "event_id string, tool_name string, success boolean, duration_ms long, created_at timestamp"
T0 = datetime(2024, 1, 1)


def batch(spark, folder, n, rows):
    spark.createDataFrame([(i, t, ok, ms, T0 + timedelta(hours=h)) for i, t, ok, ms, h in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return n


def test_rollup_deduplicates_within_the_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    batch(spark, src, 1, [("a", "x", True, 5, 1), ("a", "x", True, 5, 1), ("b", "x", False, 7, 2), ("c", "y", True, 1, 30), ("z", "y", True, 0, 24 * 9)])
    q = U.rollup(U.deduplicated(U.read_events(spark, src, SCHEMA))).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["bucket"].day, r["tool_name"]): (r["calls"], r["failures"], r["duration_ms"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "x"): (2, 1, 12), (2, "y"): (1, 0, 1)}


def test_sink_is_idempotent_over_batches(spark, tmp_path):
    src, store, check = (str(tmp_path / x) for x in ("in", "store", "check"))
    for k in range(2):
        batch(spark, src, k, [("a", "x", True, 5, 1), (f"b{k}", "x", True, 5, 1)])
        U.sink_once(spark.readStream.schema(SCHEMA).parquet(src), store, check, SCHEMA).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(store).collect()) == ["a", "b0", "b1"]


def test_chain_isolates_steps(spark, tmp_path):
    src = str(tmp_path / "in")
    batch(spark, src, 1, [("a", "x", True, 5, 1)])
    done, failed = [], []

    def bad(_):
        raise RuntimeError("no")

    U.chain(spark.readStream.schema(SCHEMA).parquet(src), [("one", lambda d: done.append(d.count())), ("bad", bad), ("two", lambda d: done.append(0))], lambda n, e: failed.append(n), str(tmp_path / "c")).awaitTermination()
    assert done == [1, 0] and failed == ["bad"]
    log = spark.createDataFrame([(i,) for i in range(5)], "sequence long")
    assert [r["sequence"] for r in U.after(log, 1, 2).collect()] == [2, 3]
