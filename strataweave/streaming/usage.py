"""Telemetry as streams: normalised, deduplicated events, windowed counts, idempotent sinks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataweave.operators.reports import insert_new


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each event_id once within the watermark, so the state does not grow for ever."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def rollup(events: DataFrame, width: str = "1 day") -> DataFrame:
    """(bucket, tool_name, calls, failures, duration_ms) by tumbling windows."""
    g = events.groupBy(F.window("created_at", width).alias("w"), "tool_name")
    return g.agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failures"), F.sum("duration_ms").alias("duration_ms")).select(F.col("w.start").alias("bucket"), "tool_name", "calls", "failures", "duration_ms")


def sink_once(events: DataFrame, store: str, checkpoint: str, schema) -> StreamingQuery:
    """Writes each event_id once, also when a batch is replayed: an anti join with what is stored, then an append."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.schema(schema).parquet(store)
        except Exception:  # noqa: BLE001 - nothing stored yet
            stored = spark.createDataFrame([], schema)
        insert_new(stored, batch.withColumn("event_id", F.col("event_id").cast("string"))).write.mode("append").parquet(store)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chain(events: DataFrame, steps: list[tuple[str, Callable[[DataFrame], None]]], failed: Callable[[str, Exception], None], checkpoint: str) -> StreamingQuery:
    """Runs the steps on every batch in order; one that fails is reported and does not stop the others."""

    def each(batch: DataFrame, _: int) -> None:
        for name, step in steps:
            try:
                step(batch)
            except Exception as e:  # noqa: BLE001 - isolation between steps is the feature
                failed(name, e)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def after(log: DataFrame, sequence: int, limit: int | None = None) -> DataFrame:
    """Replay of an event log: what follows a sequence number."""
    out = log.where(F.col("sequence") > sequence).orderBy("sequence")
    return out.limit(limit) if limit else out


class DoNotRetry(Exception):
    """A failure that no repetition mends."""


def retried(step: Callable[[DataFrame], None], poison: Callable[[DataFrame, Exception], None], limit: int = 3, first: float = 0.5, more: float = 0.5, redeliver: tuple[float, ...] = (60.0, 300.0), sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame], None]:
    """A step that is tried again `limit` times after waits of first, first + more, ... seconds, all of that once more after each wait of `redeliver`;
    a batch that still fails, or fails with DoNotRetry, goes to `poison` and the stream goes on."""

    def run(batch: DataFrame) -> None:
        failed: Exception | None = None
        for wait in (0.0, *redeliver):
            if wait:
                sleep(wait)
            for k in range(limit + 1):
                try:
                    return step(batch)
                except DoNotRetry as e:
                    return poison(batch, e)
                except Exception as e:  # noqa: BLE001 - what kind of failure it is does not matter here
                    failed = e
                    if k < limit:
                        sleep(first + k * more)
        return poison(batch, failed)

    return run


def one_at_a_time(events: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, per_batch: int = 1) -> StreamingQuery:
    """Batches one after another, each of a single partition: what a consumer with one worker does."""
    return events.writeStream.foreachBatch(lambda b, _: write(b.coalesce(per_batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
