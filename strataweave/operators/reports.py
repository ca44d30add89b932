"""Usage reports: half-open ranges, buckets with a zero-filled spine, breakdowns, facets."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "(unknown)"


def interval(start: datetime, end: datetime, asked: str = "auto") -> str:
    """day up to 45 days, week up to 180, else month, unless one is asked for."""
    if start >= end:
        raise ValueError("the range must end after it starts")
    if asked != "auto":
        return asked
    days = (end - start) / timedelta(days=1)
    return "day" if days <= 45 else "week" if days <= 180 else "month"


def within(df: DataFrame, start: datetime, end: datetime, **equal: str) -> DataFrame:
    out = df.where((F.col("created_at") >= F.lit(start)) & (F.col("created_at") < F.lit(end)))
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out


def bucket(step: str, c: str = "created_at") -> Column:
    """Start of the day, the Monday week or the month, in UTC."""
    return F.date_trunc(step, F.col(c))


def buckets(start: datetime, end: datetime, step: str) -> Column:
    first, last = F.date_trunc(step, F.lit(start).cast("timestamp")), F.date_trunc(step, F.lit(end - timedelta(microseconds=1)).cast("timestamp"))
    return F.sequence(first, last, F.expr(f"interval 1 {step}"))


def spine(df: DataFrame, start: datetime, end: datetime, step: str) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(buckets(start, end, step)).alias("bucket"))


def series(df: DataFrame, start: datetime, end: datetime, step: str, **aggs: Column) -> DataFrame:
    """One row per bucket of the spine with the aggregates, 0 where nothing happened."""
    grouped = within(df, start, end).groupBy(bucket(step).alias("bucket")).agg(*[v.alias(k) for k, v in aggs.items()])
    return spine(df, start, end, step).join(grouped, "bucket", "left").fillna(0, list(aggs))


def label(c: Column) -> Column:
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", UNKNOWN).otherwise(F.trim(c))


def breakdown(df: DataFrame, key: str, value: Column, top: int | None = None) -> DataFrame:
    """(label, value) above 0, greatest first."""
    out = df.groupBy(label(F.col(key)).alias("label")).agg(value.alias("value")).where("value > 0")
    return out.orderBy(F.desc("value"), "label").limit(top) if top else out


def breakdown_series(df: DataFrame, key: str, value: Column, start: datetime, end: datetime, step: str) -> DataFrame:
    """(label, bucket, value) for every label and bucket; labels are those of `breakdown`."""
    rows = within(df, start, end).withColumn("label", label(F.col(key)))
    keys = rows.groupBy("label").agg(value.alias("total")).where("total > 0").select("label")
    grid = keys.withColumn("bucket", F.explode(buckets(start, end, step)))
    got = rows.groupBy("label", bucket(step).alias("bucket")).agg(value.alias("value"))
    return grid.join(got, ["label", "bucket"], "left").fillna(0, ["value"])


def facets(**columns: tuple[DataFrame, str]) -> DataFrame:
    """(facet, value): sorted distinct non-blank values by facet."""
    out = None
    for name, (df, c) in columns.items():
        one = df.select(F.lit(name).alias("facet"), F.trim(F.col(c).cast("string")).alias("value")).where("value <> ''").distinct()
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def normalise_usage(df: DataFrame) -> DataFrame:
    """Negative counts become 0, a missing total the sum, a blank user `system`."""
    pos = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    total = F.when(F.coalesce(F.col("total_tokens"), F.lit(0)) > 0, F.col("total_tokens")).otherwise(pos("input_tokens") + pos("output_tokens"))
    user = F.lower(F.trim(F.coalesce("username", F.lit(""))))
    return df.withColumns({"username": F.when(user == "", "system").otherwise(user), "total_tokens": total, "input_tokens": pos("input_tokens"), "output_tokens": pos("output_tokens")})


def once(events: DataFrame, key: str = "event_id", order: str = "created_at") -> DataFrame:
    """The first delivery of every event."""
    return events.groupBy(key).agg(F.min_by(F.struct(*[c for c in events.columns if c != key]), F.col(order)).alias("m")).select(key, "m.*")


def insert_new(stored: DataFrame, incoming: DataFrame, key: str = "event_id") -> DataFrame:
    """The incoming events that are not stored yet, each once; a blank id gets one of its own."""
    named = incoming.withColumn(key, F.when(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == "", F.expr("uuid()")).otherwise(F.col(key).cast("string")))
    return named.dropDuplicates([key]).join(stored.select(F.col(key).cast("string").alias(key)), key, "left_anti")
